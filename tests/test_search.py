"""Adaptive search: its densities, and what it finds on known surfaces against random search."""

import math
import random

import numpy as np
import pytest

from eventide.operators import search, trees


@pytest.mark.parametrize("points", [[], [0.3], [0.1, 0.11, 0.5, 0.9], [0.0, 1.0]])
def test_density_is_a_mixture_of_cut_normals(points):
    m = search.Mixture(points, 0.0, 1.0)
    x = np.linspace(0, 1, 4001)
    assert np.trapezoid(m.density(x), x) == pytest.approx(1, abs=1e-6)
    at = sorted(points)
    edges = [0.0, *at, 1.0]
    want = np.zeros(len(x))
    for i, p in enumerate([*at, 0.5]):
        w = 1.0 if i == len(at) else min(max(p - edges[i], edges[i + 2] - p, 1 / min(100, 1 + len(at))), 1.0)
        phi = lambda v, p=p, w=w: 0.5 * (1 + math.erf((v - p) / w / math.sqrt(2)))
        want += np.exp(-0.5 * ((x - p) / w) ** 2) / (w * math.sqrt(2 * math.pi)) / (phi(1.0) - phi(0.0))
    assert np.allclose(m.density(x), want / (len(at) + 1))
    rng = random.Random(1)
    drawn = np.array([m.draw(rng) for _ in range(20_000)])
    shares = np.histogram(drawn, bins=20, range=(0, 1))[0] / 20_000
    mass = [np.trapezoid(m.density(np.linspace(a, a + 0.05, 101)), dx=0.0005) for a in np.arange(20) / 20]
    assert np.abs(shares - mass).max() < 0.015


def surface(s):
    return -((s["maxIter"] - 320) / 100) ** 2 - (s["maxDepth"] - 4) ** 2 - (math.log(s["stepSize"] / 0.03)) ** 2 - 4 * (s["subsamplingRate"] - 0.8) ** 2 - ((s["minInstancesPerNode"] - 3) / 5) ** 2


def test_beats_random_search_on_a_known_surface():
    wins, gain = 0, []
    for seed in range(20):
        first = lambda n: trees.random_settings(n, seed=seed)
        found = search.adaptive_search(lambda batch: [surface(s) for s in batch], trees.SEARCH, 50, first, seed)
        assert len(found) == 50 and [s for s, _ in found[:10]] == first(10)
        for s, score in found:
            assert score == surface(s)
            for name, (low, high) in trees.SEARCH.items():
                assert low <= s[name] <= high and isinstance(s[name], int) == isinstance(low, int)
        adaptive, drawn = max(v for _, v in found), max(map(surface, first(50)))
        wins, gain = wins + (adaptive >= drawn), [*gain, adaptive - drawn]
    assert wins >= 16 and np.mean(gain) > 0


def test_seeded_and_in_batches():
    sizes = []

    def score_all(batch):
        sizes.append(len(batch))
        return [surface(s) for s in batch]

    first = lambda n: trees.random_settings(n, seed=3)
    a = search.adaptive_search(score_all, trees.SEARCH, 30, first, 3)
    assert sizes == [10, 8, 8, 4] and a == search.adaptive_search(score_all, trees.SEARCH, 30, first, 3)
    assert len(search.adaptive_search(score_all, trees.SEARCH, 4, first, 3)) == 4
    batch = search.propose(a, trees.SEARCH, 8, random.Random(1))
    assert len({tuple(s.values()) for s in batch}) == 8
