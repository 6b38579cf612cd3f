"""Names after capitalised words, names that only context or a title tells, secrets in identifiers of any case."""

import hashlib
import random

import numpy as np
import pytest
from test_operators import SCHEMA

from factweave.llm import pii


def found(text):
    return {(pii.KINDS[k], text[a:b]) for a, k, b, *_ in pii.candidates(text, pii.base_spans(text))}


@pytest.mark.parametrize("text,name", [
    ("Dear John Smith, hello", "John Smith"), ("see Dr Sarah Brown there", "Sarah Brown"), ("Contact Mary Jones now", "Mary Jones"),
    ("Dear Zoltan Kovacs, hello", "Zoltan Kovacs"), ("with Prof. Ngozi Eze today", "Ngozi Eze"),
])
def test_names(text, name):
    assert ("name", name) in found(text)


def test_pairs_that_nothing_speaks_for_get_no_vote():
    assert not any(pii.spoken(votes) for *_, votes, _ in pii.candidates("We went to Grand Canyon last year. Big Trees were there.", []))


@pytest.mark.parametrize("before", ["API_KEY=", "Password: ", "auth_token=", "the token = \"", "url: client_secret=", "X-Api-Key: ", "dbPassword='", '"ACCESS_KEY_ID": "'])
def test_secrets(before):
    value = hashlib.sha1(b"x").hexdigest()
    assert ("secret", value) in found(f"{before}{value}\"")


def test_votes_vary():
    votes = lambda text: {v[0] for *_, v, _ in pii.candidates(text, [])}
    assert votes("call 523-555-1000") == {"+"} and votes("call 2024-05-17") == {"-"} and votes("see 12-3456-78") == {"0"}
    assert "+" in votes("see Dr Sarah Brown") and votes("see Sarah Brown") == {"0"}


FIRST = "Zoltan Ngozi Björn Çelik Aoife Priya Tomasz Yuki Oksana Rafael Søren Mette Kwame Leila Dmitri Agnieszka".split()
LAST = "Kovacs Eze Håkansson Demir Murphy Raman Kowalski Tanaka Shevchenko Oliveira Nielsen Jensen Mensah Haddad Petrenko Nowak".split()
PLACES = "Grand Canyon|Blue River|New Harbour|Old Mill|Green Valley|Silver Lake|Iron Bridge|Long Island|Big Trees|Stone Gate".split("|")


def planted(n, seed):
    """Documents, and the added spans in each: names, keys, local numbers and ids among decoys of the same form."""
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8)))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    for i in range(n):
        parts, spans, at = [], set(), 0

        def say(text, kind=None):
            nonlocal at
            if kind:
                spans.add((kind, at, at + len(text)))  # noqa: B023
            parts.append(text)  # noqa: B023
            at += len(text)

        for _ in range(rng.randint(3, 7)):
            say(" ".join(word() for _ in range(rng.randint(3, 9))) + " ")
            name = f"{rng.choice(FIRST)} {rng.choice(LAST)}"
            pick = rng.randrange(11)
            if pick < 3:
                say(rng.choice(["Dear ", "signed by ", "Dr ", "contact ", "named ", "Prof. "]))
                say(name, "name")
            elif pick == 3:  # no cue: the corpus gazetteer must know it
                say(name, "name")
            elif pick == 4:
                say(rng.choice(["we saw ", "near ", "around "]) + rng.choice(PLACES))
            elif pick == 5:
                say(rng.choice(["password=", "token = ", "api_key: "]))
                say(hexes(rng.choice([18, 32, 40])), "secret")
            elif pick == 6:
                say(rng.choice(["commit ", "checksum ", "digest ", "sha1 "]) + hexes(40))
            elif pick == 7:
                say(rng.choice(["call ", "phone ", "fax "]))
                say(f"({rng.randint(200, 989)}) {rng.randint(200, 989)}-{rng.randint(1000, 9999)}", "local_phone")
            elif pick == 8:
                say(rng.choice([f"on 20{rng.randint(10, 24)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"version {rng.randint(10, 99)}.{rng.randint(10, 99)}.{rng.randint(10, 99)}", f"isbn 978-{rng.randint(10, 99)}-{rng.randint(100, 999)}-{rng.randint(100, 999)}"]))
            elif pick == 9:
                say(rng.choice(["ssn ", "social security "]))
                say(f"{rng.randint(100, 599)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", "national_id")
            else:
                say("AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), "secret")
            say(rng.choice([" ", ", ", ". "]))
        out.append((i, "".join(parts), spans))
    return out


def test_precision_and_recall_on_planted_spans(spark):
    truth = planted(500, 3)
    rows = [(i, t, "en", "s", 0, "", 0, 0.0, "", 0) for i, t, _ in truth]
    found, model = pii.find(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert {"Ngozi", "Kovacs"} <= model.gazetteer and not model.gazetteer & {"Grand", "River"}
    said = {r.doc_id: {(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k in pii.ADDED} for r in found.collect()}
    for kind in pii.ADDED:
        want = {(i, *s) for i, _, spans in truth for s in spans if s[0] == kind}
        got = {(i, *s) for i, spans in said.items() for s in spans if s[0] == kind}
        assert len(want & got) >= 0.9 * len(want), (kind, "recall", len(want & got), len(want))
        assert len(want & got) >= 0.9 * len(got), (kind, "precision", len(want & got), len(got))
    # Texts the model has not seen.
    other = planted(200, 4)
    hits = sum(len(spans & set((pii.KINDS[k], a, b) for a, k, b in model.chosen(t, pii.candidates(t, [])))) for _, t, spans in other)
    assert hits >= 0.9 * sum(len(spans) for *_, spans in other)


def test_spans_and_redaction(spark):
    rows, plain = [], "word " * 20
    names = ["John Smith", "Sarah Brown", "Mary Jones", "Zoltan Kovacs"]
    for i in range(60):
        value = hashlib.sha1(bytes([i])).hexdigest()
        text = f"{plain}Dear {names[i % 4]}, see Dr {names[(i + 1) % 4]}. {['API_KEY=', 'Password: ', 'auth_token='][i % 3]}{value} {plain}"
        rows.append((i, text, "en", "s", len(text), "", 0, 0.0, "", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    spans = {r.doc_id: r.spans.split(",") for r in pii.find(docs)[0].collect()}
    clean = {r.doc_id: r.text for r in pii.redact(docs)[0].collect()}
    for i, text, *_ in rows:
        got = {(k, text[int(a) : int(b)]) for k, a, b in (s.split(":") for s in spans[i])}
        assert got == {("name", names[i % 4]), ("name", names[(i + 1) % 4]), ("secret", hashlib.sha1(bytes([i])).hexdigest())}
        assert "Dear [NAME], see Dr [NAME]." in clean[i] and clean[i].count("[SECRET]") == 1


def test_the_likeliest_of_overlapping_spans_stays(monkeypatch):
    model = pii.SpanModel({"name": {}}, np.zeros(pii.PLACES), frozenset())
    monkeypatch.setattr(pii.SpanModel, "probability", lambda self, kind, votes, features: {"a": 0.6, "b": 0.9, "c": 0.9, "d": 0.2}[votes[0]])
    found = [(0, 6, 9, "a00", []), (5, 6, 14, "b00", []), (10, 7, 20, "c00", []), (30, 6, 40, "d00", []), (41, 6, 50, "a00", [])]
    assert model.chosen("x y " * 20, found) == [(5, 6, 14), (41, 6, 50)]


def test_context_tells_spans_that_have_equal_votes():
    rows, label = [], {(6, "0+000"): 0.5, (6, "++000"): 1.0, (6, "0+-00"): 0.0}
    for i in range(200):
        near, other = [i % 7], [100 + i % 7]
        rows += [(6, "++000", near), (6, "0+-00", other)]
    model = pii.SpanModel({"name": {}}, pii.fit(rows, label), frozenset())
    assert model.probability(6, "0+000", [3]) > 0.6 > 0.4 > model.probability(6, "0+000", [103])
