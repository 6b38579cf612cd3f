"""Each operator against brute force on small tables with nulls, ties, repeats, empties and clashing columns."""

import base64
import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import decision_list, line_blocks, minhash, packing, pii, suffix_dedup, tool_calls, warc, water_filling, weighted_sampling
from factweave.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, digest int, key double, size string, bin int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def make(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = text(40)
    texts = [text(rng.randint(1, 200)) for _ in range(n)]
    base = text(120).split()
    for i in range(12):
        edited = list(base)
        for _ in range(i // 2):
            edited[rng.randrange(len(edited))] = "changed"
        texts.append(" ".join(edited))
    texts += [passage + " " + text(30), text(20) + " " + passage, "same text here", "same text here", "", "   \n\t ", None, "A\n" * 50, "x " * 300, "word\x0bword\x85word   end"]
    texts += [texts[3], texts[3], text(60) + " mail me at a.b+c@mail.example.org or +1 (523) 555-1055, card 4111 1111 1111 1111, ip 10.0.0.256 and 8.8.8.8"]
    texts.append(text(9000))
    rows = [(i * 3, t, "en", ["a", "b", None, "é", "a"][i % 5], len(t or ""), "n", 1, 0.5, "s", 2) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, "no id here", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# 1. Tool calls

def call(i, name, **arguments):
    return f"<tool_call>{json.dumps({'id': i, 'name': name, 'arguments': arguments})}</tool_call>"


def test_tool_calls(spark):
    schemas = {"add": {"type": "object", "properties": {"a": {"type": ["number", "object"]}}, "required": ["a"], "additionalProperties": False}}
    talk = [
        (1, 0, "user", 'say "é"\n', 0), (1, 1, "assistant", "ok " + call("c2", "add", a={"$ref": "c1"}) + call("c1", "add", a=1) + "<tool_call>bad</tool_call>", 0),
        (1, 2, "tool", '{"tool_call_id":"c1","content":3}', 0), (1, 3, "tool", '{"tool_call_id":"zz"}', 0),
        (1, 4, "assistant", call("c3", "add", a={"$ref": "c4"}, z=1) + call("c4", "mul", a={"$ref": "c3"}), 0), (None, None, None, None, None), (2, 0, "user", "", 1),
    ]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string, json int")
    out = {(r.conv_id, r.turn): r for r in tool_calls.format_messages(df, schemas).collect()}
    assert len(out) == len(talk)
    for r in out.values():
        assert tool_calls.canonical(json.loads(r.json)) == r.json
    first = json.loads(out[1, 1].json)
    assert [c["id"] for c in first["tool_calls"]] == ["c1", "c2"] and out[1, 1].malformed == 1 and out[1, 1].n_linked == 1
    assert out[1, 4].n_invalid == 2 and out[1, 2].answers and not out[1, 3].answers
    status = {(r.call_id): (r.status, r["rank"]) for r in tool_calls.links(df, schemas).collect()}
    assert status == {"c1": ("linked", 0), "c2": ("unanswered", 1), "c3": ("unanswered", None), "c4": ("unanswered", None), "zz": ("orphan", None)}
    assert tool_calls.format_messages(df.where("false")).count() == 0


# 2. Personal data

def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(d[-1::-2]) + sum(x * 2 - 9 * (x > 4) for x in d[-2::-2])
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def test_base_spans_on_noise():
    rng = random.Random(4)
    for _ in range(20000):
        t = "".join(rng.choice("a1.@-+ _%(5") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == base_spans(t), t


def test_personal_data(spark, docs, rows, none):
    more = [(10_000 + i, f"the token = \"{hashlib.sha1(bytes([i])).hexdigest()}\" and call (523) 555-{1000 + i} now, version 1-22-3", "en", "a", 0, "", 0, 0.0, "", 0) for i in range(30)]
    found, model = pii.find(docs.union(spark.createDataFrame(more, SCHEMA)))
    got = collections.Counter((r.doc_id, r.base_sha256) for r in found.collect())
    want = collections.Counter()
    for doc, t, *_ in rows + more:
        spans = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base_spans(t or ""))
        want[doc, hashlib.sha256(spans.encode()).hexdigest()] += 1
    assert got == want
    spans = {r.doc_id: r.spans for r in found.collect()}
    assert "secret:" in spans[10_001] and "local_phone:" in spans[10_001] and set(model.reliability) >= {"secret", "local_phone"}
    clean, _ = pii.redact(docs)
    texts = {r.doc_id: r for r in clean.collect()}
    planted = next(r for r in rows if r[1] and "mail me" in r[1])
    assert "[EMAIL]" in texts[planted[0]].text and "[PHONE]" in texts[planted[0]].text and "[CARD]" in texts[planted[0]].text and "8.8.8.8" not in texts[planted[0]].text
    assert texts[planted[0]].n_chars == len(texts[planted[0]].text) and clean.columns == docs.columns
    assert pii.find(none)[0].count() == 0 and pii.redact(none)[0].count() == 0


def test_em_tells_reliable_labelers():
    rng = random.Random(2)
    counts = collections.Counter()
    for _ in range(5000):
        y = rng.random() < 0.4
        vote = lambda p: "+" if (y if rng.random() < p else not y) else "-"  # noqa: E731, B023
        counts[7, vote(0.95) + vote(0.9) + vote(0.5) + vote(0.85) + vote(0.6)] += 1
    reliability, label = pii.posteriors([(k, key, n) for (k, key), n in counts.items()])
    r = reliability["secret"]
    assert r["pattern"] > r["shape"] > 0.5 > r["context"] - 0.1
    assert label[7, "+++++"] > 0.9 and label[7, "---+-"] < 0.1 and label[7, "-----"] == 0


# 3. Fingerprints

def terms(text):
    w = (text or "").encode().lower().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def test_fingerprints(docs, rows, none):
    got = collections.defaultdict(list)
    for r in weighted_sampling.fingerprints(docs, partitions=4).collect():
        got[r.doc_id].append(r)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    errors = []
    for i, (doc, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        match = [r for r in got[doc] if r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()]
        assert match and match[0].n_chars == len(text)
        for near, other in ((match[0].near_edited, edited), (match[0].near_next, after)):
            a, b = terms(text), terms(other)
            true = sum((a & b).values()) / sum((a | b).values()) if a | b else 1.0
            errors.append(near - true)
            assert abs(near - true) < 0.35 and (text != other or near == 1.0)
    assert abs(np.mean(errors)) < 0.03
    assert weighted_sampling.fingerprints(none).count() == 0
    one = docs.where("doc_id = 0")
    assert weighted_sampling.fingerprints(one).first().near_next == 1.0


def test_weighted_collisions_estimate_generalised_jaccard():
    sampler = weighted_sampling.Sampler(4096)
    keys = np.random.default_rng(0).integers(0, 1 << 63, 40, dtype=np.uint64)
    a, b = np.arange(1, 41), np.arange(40, 0, -1)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert weighted_sampling.likeness(sampler.signature(keys, a), sampler.signature(keys, b)) == pytest.approx(want, abs=0.03)


# 4. WARC

PAGES = [(i, f"http://x/{i}", ["<p>é</p>\r\n\r\nWARC/1.1\r\n", "", None, "unique %d" % i][i % 4], "extra", 1) for i in range(20)] + [
    (50, None, "<p>é</p>\r\n\r\nWARC/1.1\r\n", "", 2), (51, "http://a b/\n", "q" * 100_000, "", 3), (None, "u", "", "", 4), (None, "u", "alone", "", 5), (51, "http://a b/\n", "q" * 100_000, "", 3)]
PAGE_SCHEMA = "page_id long, url string, html string, record_type string, digest int"


@pytest.mark.parametrize("least", [0, 10])
def test_warc_round_trip(spark, tmp_path, least):
    pages = spark.createDataFrame(PAGES, PAGE_SCHEMA).repartition(3)
    best = {}
    for p, _, h, *_ in PAGES:
        best[h or ""] = max([x for x in (p, best.get(h or "")) if x is not None], default=None)
    got = collections.Counter(tuple(r) for r in warc.round_trip(pages, min_bytes=least, file_bytes=1 << 12).collect())
    want = collections.Counter()
    for p, _, h, *_ in PAGES:
        data = (h or "").encode()
        visits = best[h or ""] is not None and best[h or ""] != p and len(data) >= least
        want[p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if visits else "response", best[h or ""] if visits else None] += 1
    assert got == want
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, min_bytes=least)
    texts = collections.Counter((r.page_id, r.payload) for r in warc.resolved(warc.read_archives(spark, path)).collect())
    assert texts == collections.Counter((p, h or "") for p, _, h, *_ in PAGES)
    assert warc.round_trip(pages.where("false")).count() == 0


# 5. Decision lists

def stats(text):
    w = WORDS.findall(text or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often, covered, seen, repeated = collections.Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered.update(range(i, i + 8))
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


def test_text_stats(docs, rows, none):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = collections.Counter((r.doc_id, *(r[n] for n in names)) for r in decision_list.with_stats(docs).select("doc_id", "__stats.*").collect())
    assert got == collections.Counter((d, *stats(t)) for d, t, *_ in rows)


def test_learned_list_holds_out(spark, none):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    data, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        ws = [word() + ("$$$" if bad and i % 8 else "") for _ in range(rng.randint(25, 80))]
        text = " ".join(ws).upper() if bad and i % 8 == 0 else " ".join(ws)
        data.append((i, text, "en", "s", len(text), "", 0, 0.0, "", 0))
        if i % 3:
            labels.append((i, None if i % 50 == 1 else int(not bad), 0))
    docs = spark.createDataFrame(data, SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    report, rules = decision_list.quality_report(docs, marks)
    assert rules.rules and all(r.kept == bool(r.doc_id % 4) for r in report.where("doc_id % 3 = 0").collect())
    kept, _ = decision_list.quality_filter(docs, marks)
    assert kept.count() == 450 and kept.columns == docs.columns
    empty, no_rules = decision_list.quality_report(docs, marks.where("false"))
    assert not no_rules.rules and empty.where("kept").count() == 600
    assert decision_list.quality_report(none, marks)[0].count() == 0


# 6. Line blocks

@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain", "plain"),
    ("<nav><a>m</a></nav><article><h1>T &amp; t</h1><p>one\n two<br><p>three</article><footer>f</footer>", "T & t\none two\nthree"),
    ("<body><div class='ad'>buy</div><div><p>A long paragraph of plain text.</p><p>Short.</p></div><div id='comments'><p>reader</p></div>", "A long paragraph of plain text.\nShort."),
    ("<article><p>a</p><form>x</form><aside>y</aside><p>b</p><script>var t='</p>';</script></article>", "a\nb"),
    ("<main><p>kept</p></main><section class='comments'><article><p>no</p></article></section>", "kept"),
    ("<header><p>site</p></header><article><header><h1>Title</h1></header><p>t</p></article>", "Title\nt"),
    ("<article><p>a &lt;b&gt; &eacute;</p><!-- <p>hidden</p> --><p hidden>no</p></article>", "a <b> é"),
])
def test_main_text(page, text):
    assert line_blocks.main_text(page) == text


def test_extract(spark):
    df = spark.createDataFrame(PAGES, PAGE_SCHEMA)
    got = collections.Counter((r.page_id, r.url, r.text, r.n_chars) for r in line_blocks.extract(df).collect())
    assert got == collections.Counter((p, u, t := line_blocks.main_text(h), len(t)) for p, u, h, *_ in PAGES)
    rng = random.Random(3)
    bits = ["<", ">", "p", '"', "<div class=ad>", "</div>", "<!--", "-->", "<script>", "</script>", "<article>", "</article>", "='"]
    for _ in range(500):
        line_blocks.main_text("".join(rng.choice(bits) for _ in range(60)))


# 7. Packing

def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    import public_tokenizers

    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs, capacity=256, slack=2, task_items=40, fan_in=2).collect()
    want, total = collections.Counter(), 0
    for doc, text, *_ in rows:
        ids = bpe.encode(text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)] if len(ids) > 256 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.1 * -(-total // 256) and packing.pack(none).count() == 0


def test_best_fit():
    assert packing.best_fit([6, 5, 5, 4], 10) == [0, 1, 1, 0]
    assert packing.best_fit([10, 10, 1], 10) == [0, 1, 2] and packing.best_fit([], 4) == []


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    import public_tokenizers

    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own, rng = packing.encoder(packing.default_vocabulary()), random.Random(3)
    bits = [" ", "\n", "a", "b", "the", "'s", "'", "1", "23", ".", "é", "\t", "\r", " ", "漢", "<|endoftext|>", "  "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == bpe.encode(t, add_special_tokens=False).ids, t


# 8. Mixing

def test_mix(docs, rows, none):
    got = water_filling.mix(docs).collect()
    size, weight, left = collections.Counter(), {}, None
    for _, t, _, s, *_ in rows:
        size[s] += len(WORDS.findall(t or ""))
    for i, s in enumerate(sorted(size, key=lambda s: (s is None, (s or "").encode()))):
        weight[s] = (3, 1, 2)[i % 3]
    target, free, left = {}, set(size), 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * size[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
        left -= sum(target[s] for s in full)
        free -= full
    target |= {s: level * weight[s] for s in free}
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    biggest = {s: max(len(WORDS.findall(t or "")) for _, t, _, x, *_ in rows if x == s) for s in size}
    assert all(abs(taken[s] - target[s]) <= biggest[s] for s in size)
    assert sorted(map(str, got)) == sorted(map(str, water_filling.mix(docs.repartition(5)).collect()))
    copies = collections.Counter(r.doc_id for r in water_filling.resample(docs).collect())
    repeats = collections.Counter()
    for r in got:
        repeats[r.doc_id] += r.repeats
    # Rows alike in everything the draw sees are taken alike, so the repeated row may differ by one.
    assert all(abs(copies[d] - n) <= (d == rows[5][0]) for d, n in repeats.items())
    assert water_filling.mix(none).count() == 0 and water_filling.resample(none).count() == 0


# 9. Repeated passages

def brute_removed(rows, length=50):
    least = {}
    data = [(float("inf") if d is None else d, (t or "").encode()) for d, t, *_ in rows]
    for d, b in data:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            least[w] = min(d, least.get(w, d))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((None if d == float("inf") else d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("batches,shard_bytes", [(1, 1 << 24), (4, 1 << 24), (7, 5000)])
def test_repeated_spans(spark, docs, rows, none, batches, shard_bytes):
    before = {t.name for t in spark.catalog.listTables()}
    got = suffix_dedup.repeated_spans(docs, batches=batches, shard_bytes=shard_bytes).drop("removed").collect()
    assert collections.Counter(map(tuple, got)) == brute_removed(rows)
    assert suffix_dedup.repeated_spans(none).count() == 0
    assert {t.name for t in spark.catalog.listTables()} == before


def test_colliding_hashes_remove_nothing_innocent(docs, rows):
    want = {(d, n): (removed, digest) for d, n, removed, _, digest in brute_removed(rows)}
    got = suffix_dedup.repeated_spans(docs, bits=9, shard_bytes=5000).collect()
    assert len(got) == len(rows) and all(r.n_removed <= want[r.doc_id, r.n_bytes][0] for r in got)
    assert any(r.n_removed for r in got)


def test_suffix_arrays():
    rng = random.Random(2)
    data = [bytes(rng.choices(b"ab\xff\x00", k=rng.randint(24, 60))) for _ in range(300)] + [b"a" * 24, b"a" * 30]
    words = suffix_dedup._prefixes(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])[:-1])
    order = suffix_dedup._suffix_order(words)
    first = [data[i][:24] for i in order]
    assert first == sorted(d[:24] for d in data)
    common = [0] + [next((i for i in range(24) if a[i] != b[i]), 24) for a, b in zip(first, first[1:])]
    assert suffix_dedup._common_prefixes(words[:, order]).tolist() == common
    row = suffix_dedup._level_row(3, words.copy(), np.arange(len(data)), np.arange(len(data)))
    again = suffix_dedup._level_arrays(row)
    assert (again[0] == words[:, order]).all() and again[1].tolist() == order.tolist()
    r = suffix_dedup.Runs([b"".join(data)])
    whole = np.frombuffer(b"".join(data), np.uint8)
    assert (suffix_dedup._prefix_keys(suffix_dedup._prefixes(whole, r.anchor)) == r.key).all()


def test_runs_over_buffers(monkeypatch):
    data = [bytes(random.Random(i).choices(b"abc ", k=n)) for i, n in enumerate((10, 49, 50, 51, 5000, 70, 300))]
    whole = suffix_dedup.Runs(data)
    monkeypatch.setattr(suffix_dedup, "STEP", 256)
    split = suffix_dedup.Runs(data)
    cover = lambda r: sorted((d, s, k) for d, k, a, b in zip(r.doc, r.key, r.first, r.last) for s in range(a, b + 1))
    assert cover(whole) == cover(split) and len(cover(whole)) == sum(max(0, len(d) - 49) for d in data)


# 10. Near-duplicates

def brute_components(rows, percent=85):
    sets = [frozenset(terms(t)) for _, t, *_ in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                group[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None and sets[i]:
            least[find(i)] = min(d, least.get(find(i), d))
    return collections.Counter((d, len(s), least.get(find(i), d) if s else d) for i, ((d, *_), s) in enumerate(zip(rows, sets)))


def test_near_duplicates(docs, rows, none):
    got = minhash.near_duplicates(docs).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = minhash.keep_one(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) == len({r.component_id for r in got}) and kept.columns == docs.columns
    assert minhash.near_duplicates(none).count() == 0 and minhash.keep_one(none).count() == 0


def test_crowd_of_edited_copies(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    crowd = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        crowd.append((i, " ".join(words), "en", "s", 0, "", 0, 0.0, "", 0))
    got = minhash.near_duplicates(spark.createDataFrame(crowd, SCHEMA)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(crowd)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (10, 11), (11, 12), (12, 13), (13, 14), (5, 5), (20, 21), (21, 20)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3)}, **{i: 10 for i in range(10, 15)}, 20: 20, 21: 20, **{i: 100 for i in range(100, 141)}}
