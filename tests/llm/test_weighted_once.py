import numpy as np
import pytest

from factweave.llm.weighted_sampling import Sampler


@pytest.mark.parametrize("n", [1, 40, 700, 3000])
def test_no_variate_is_worked_out_twice(n, monkeypatch):
    """The term of the least bound is tried first, and not again among those that the bound leaves."""
    rng = np.random.default_rng(n)
    terms = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    weights = rng.choice([1, 1, 1, 2, 5], len(terms))
    sampler, seen, exact = Sampler(), [], Sampler.exact
    monkeypatch.setattr(Sampler, "exact", lambda self, sample, x, *more: (seen.extend(zip(sample.tolist(), x.tolist())), exact(self, sample, x, *more))[1])
    assert len(sampler.signature(terms, weights)) == 64
    assert len(seen) == len(set(seen)) and {s for s, _ in seen} == set(range(64))
