"""Signatures put together from parts of texts equal those of whole texts, and no text's terms are drawn twice."""

import random

import numpy as np
import pyarrow as pa
import pytest

from factweave.llm import weighted_sampling
from factweave.llm.weighted_sampling import Sampler, _groups, _Text, edited_text, signatures


def texts_of(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcÄé\x85　", k=rng.randint(1, 6))) for _ in range(400)]
    spaces = [" ", " ", " ", "\n", " \t ", "\x0b", "\x0c\r"]
    some = lambda n, of=words: "".join(rng.choice(of) + rng.choice(spaces) for _ in range(n))
    texts = ["", " ", "\n\t ", "one", " one", "one ", "a b", "a b c d", "a b c d e", "x" * 90, "\ud800 lone \udc00 halves " * 9, "x " * 300, "A\n" * 50]
    texts += [some(n) for n in (1, 2, 4, 5, 6, 8, 9, 10, 11, 12, 13, 40, 300, 2500)] + [some(300, words[:3]), some(3000, words[:2])]
    texts += [some(20).strip() for _ in range(20)] + [some(60) * 2, some(200)] + ["same text as the one that follows it"] * 3
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,group,round_", [(1, 1, 16384), (2, 3, 16384), (3, 32, 16384), (4, 7, 100), (5, 32, 2000)])
def test_parts_equal_whole_texts(seed, group, round_, monkeypatch):
    monkeypatch.setattr(weighted_sampling, "ROUND", round_)
    texts, sampler, before, own, edited = texts_of(seed), Sampler(64), None, [], []
    for start in range(0, len(texts), group):
        some, new, before = signatures(sampler, [_Text(t) for t in texts[start : start + group]], before)
        own += some
        edited += new
    assert len(own) == len(texts) and len(edited) == len(texts) - 1
    for got, text in zip(own + edited, texts + [edited_text(a, b) for a, b in zip(texts, texts[1:])]):
        want = sampler.of_text(text)
        assert got.shape == want.shape and (got == want).all(), repr(text[:200])


def test_edited_texts_draw_only_their_seams(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(rng.randint(200, 400))) for _ in range(40)]
    drawn, draws = [0], Sampler._draws
    monkeypatch.setattr(Sampler, "_draws", lambda self, terms: (drawn.__setitem__(0, drawn[0] + len(terms)), draws(self, terms))[1])
    signatures(Sampler(64), [_Text(t) for t in texts], None)
    terms = sum(len(t.split()) - 4 for t in texts)
    assert terms <= drawn[0] < 1.1 * terms


def test_groups_are_bounded(monkeypatch):
    monkeypatch.setattr(weighted_sampling, "GROUP_BYTES", 100)
    texts = ["a" * n if n else None for n in (0, 10, 90, 1, 500, 0, 0, *[2] * 70, 100)]
    groups = [g.column(1).to_pylist() for g in _groups(pa.record_batch({"doc_id": np.arange(len(texts)), "text": pa.array(texts)}))]
    assert sum(groups, []) == texts and max(map(len, groups)) == 32
    assert all(len(g) == 1 or sum(len(t or "") for t in g) <= 100 for g in groups)
    assert not list(_groups(pa.record_batch({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})))
