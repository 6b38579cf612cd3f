"""Hashes of stretches and merge-scans of suffix arrays: right, and by arrays rather than one call an entry."""

import cProfile
import pstats
import random

import numpy as np

from factweave.llm import suffix_dedup


def _texts_and_stretches(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP", 4096)
    rng = random.Random(4)
    data = [bytes(rng.choices(b"ab\0", k=rng.choice((5, 76, 300, 9000)))) for _ in range(60)] + [b""]
    where = sorted((d, a, min(len(t), a + rng.choice((1, 2, 3, 50, 76)))) for d, t in enumerate(data) for a in range(0, len(t), 7))
    return data, *np.array(where).T


def test_equal_stretches_have_equal_hashes(monkeypatch):
    data, docs, first, end = _texts_and_stretches(monkeypatch)
    found = suffix_dedup._confirming(data, docs, first, end).tolist()
    texts = [data[d][a:b] for d, a, b in zip(docs, first, end)]
    assert len(set(zip(texts, found))) == len(set(texts)) == len(set(found)) < len(texts)
    none = np.empty(0, np.int64)
    assert len(suffix_dedup._confirming(data, none, none, none)) == 0


def test_stretches_take_no_call_each(monkeypatch):
    data, docs, first, end = _texts_and_stretches(monkeypatch)
    suffix_dedup._confirming(data, docs, first, end)
    profile = cProfile.Profile()
    profile.runcall(suffix_dedup._confirming, data, docs, first, end)
    assert len(docs) > 10_000 and pstats.Stats(profile).total_calls < len(docs) / 4


def test_seeds_of_merged_arrays():
    rng = random.Random(5)
    texts = [bytes(rng.choices(b"a\0\xff", k=2)) * 4 + bytes(rng.choices(b"b\0", k=1)) * 8 + bytes(rng.choices(b"cd\0", k=2)) * 4 for _ in range(120)]
    whole = np.frombuffer(b"".join(texts), np.uint8)
    words, shards = suffix_dedup._prefixes(whole, np.arange(0, len(whole), 24)), np.array([rng.randrange(9) for _ in texts], np.uint32)
    # A shard lists an anchor once.
    once = sorted({(t, s): i for i, (t, s) in enumerate(zip(texts, shards.tolist()))}.values())
    halves = [suffix_dedup._level_arrays(suffix_dedup._level_row(0, words[:, at], shards[at], at)) for at in (np.array(once[:50]), np.array(once[50:]))]
    found = suffix_dedup._seeds(suffix_dedup._both(*halves)).to_pydict()
    got = {(s, k) for s, body in zip(found["shard"], found["body"]) for k in np.frombuffer(body, np.uint64).tolist()}
    keys = suffix_dedup._prefix_keys(words).tolist()
    holders = {}
    for t, s in zip(texts, shards.tolist()):
        holders.setdefault(t, set()).add(s)
    assert got == {(s, keys[i]) for i, (t, s) in enumerate(zip(texts, shards.tolist())) if len(holders[t]) > 1} and got
    nothing = suffix_dedup._level_arrays(suffix_dedup._LEVEL.empty_table())
    assert suffix_dedup._seeds(nothing).num_rows == suffix_dedup._seeds((words[:, :1], shards[:1], shards[:1])).num_rows == 0
