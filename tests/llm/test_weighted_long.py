"""Weighted samples of long texts: the exact least value, and collisions at the generalised Jaccard similarity."""

import numpy as np
import pytest

from factweave.llm.weighted_sampling import GOLDEN, Sampler, gamma_quantile, likeness, mixed


def keys(n, seed):
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


def test_quantiles():
    x = np.array([1e-7, 1e-4, 0.01, 1.0, 5.0, 25.0])
    share = np.where(x < 1e-2, x**2 / 2 - x**3 / 3 + x**4 / 8, 1 - (1 + x) * np.exp(-x))
    assert gamma_quantile(share) == pytest.approx(x, rel=1e-3) and gamma_quantile(np.zeros(1))[0] == 0


@pytest.mark.parametrize("n", [1, 3, 300, 5000])
def test_bounds_lose_nothing(n):
    sampler, terms = Sampler(64), keys(n, n)
    weights = np.where(np.arange(n) % 3, 1, np.arange(n) % 50 + 1)
    draws, want = sampler._draws(terms), []
    for i in range(64):
        value, t = sampler.exact(np.full(n, i), terms, draws[i], np.log(weights))
        least = value.argmin()
        want.append(terms[least] + t[least].astype(np.uint64) * GOLDEN)
    assert (sampler.signature(terms, weights) == (mixed(np.array(want)) >> np.uint64(48)).astype(np.uint16)).all()


@pytest.mark.parametrize("light,heavy", [(10_000, 1_000), (50_000, 500), (200_000, 2_000)])
def test_collisions_of_long_texts(light, heavy):
    sampler = Sampler(400)
    shared, a, b = keys(heavy, 1), keys(light, 2), keys(light, 3)
    weights = np.repeat([10, 1], [heavy, light])
    signatures = [sampler.signature(np.concatenate([shared, own]), weights) for own in (a, b)]
    want = 10 * heavy / (10 * heavy + 2 * light)
    assert likeness(*signatures) == pytest.approx(want, abs=4 * (want * (1 - want) / 400) ** 0.5)


def test_collisions_of_mixed_weights():
    sampler, terms, rng = Sampler(400), keys(60_000, 4), np.random.default_rng(5)
    a, b = rng.geometric(0.5, 60_000), rng.geometric(0.5, 60_000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert likeness(sampler.signature(terms, a), sampler.signature(terms, b)) == pytest.approx(want, abs=4 * (want * (1 - want) / 400) ** 0.5)
