"""Adaptive search of settings: a tree-structured Parzen estimator that proposes whole batches of trials.

After some random trials, the best share of all trials so far gives one density per setting, the others another. Of some draws
from the first, those are tried next whose ratio of both densities is largest. A batch is proposed at a time, so that its trials
can be fitted side by side; draws of one batch that are not yet scored count as trials of the worse kind, which keeps
the batch apart. Densities are mixtures of normals around the trials, and the uniform one, over the setting's range (its logarithm
where it is a step size), cut off at its ends.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

import numpy as np

STARTUP, BATCH, CANDIDATES, BEST_SHARE = 10, 8, 24, 0.25
LOGARITHMIC = {"stepSize"}


def _scale(name: str, bounds: tuple) -> tuple[float, float]:
    """Ends of a setting's range on its scale; whole numbers get half a step beyond."""
    low, high = bounds
    if name in LOGARITHMIC:
        return math.log(low), math.log(high)
    return (low - 0.5, high + 0.5) if isinstance(low, int) else (low, high)


def _place(name: str, value: float) -> float:
    return math.log(value) if name in LOGARITHMIC else float(value)


def _value(name: str, bounds: tuple, place: float):
    if name in LOGARITHMIC:
        return min(max(math.exp(place), bounds[0]), bounds[1])
    return min(max(round(place), bounds[0]), bounds[1]) if isinstance(bounds[0], int) else place


def _cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))


class Mixture:
    """Density over [low, high]: normals around some points, each cut off at the ends, and one around the middle as wide as the range.

    A point's width is its distance to the next point or end that is further away, within limits.
    """

    def __init__(self, points: list[float], low: float, high: float):
        self.low, self.high = low, high
        at = np.array(sorted(points))
        edges = np.r_[low, at, high]
        width = np.maximum(edges[1:-1] - edges[:-2], edges[2:] - edges[1:-1]) if len(at) else at
        least = (high - low) / min(100, 1 + len(at))
        self.at = np.r_[at, (low + high) / 2]
        self.width = np.r_[np.clip(width, least, high - low), high - low]
        self.mass = _cdf((high - self.at) / self.width) - _cdf((low - self.at) / self.width)

    def density(self, x: np.ndarray) -> np.ndarray:
        z = (np.asarray(x, float)[:, None] - self.at) / self.width
        return (np.exp(-0.5 * z * z) / (self.width * math.sqrt(2 * math.pi) * self.mass)).mean(axis=1)

    def draw(self, rng: random.Random) -> float:
        k = rng.randrange(len(self.at))
        while True:
            x = rng.gauss(self.at[k], self.width[k])
            if self.low <= x <= self.high:
                return x


def propose(done: list[tuple[dict, float]], space: dict, n: int, rng: random.Random) -> list[dict]:
    """The next ``n`` settings, given settings with their scores (higher is better)."""
    ranked = sorted(range(len(done)), key=lambda i: (-done[i][1], i))
    best = {i for i in ranked[: max(1, math.ceil(BEST_SHARE * len(done)))]}
    out: list[dict] = []
    for _ in range(n):
        setting = {}
        for name, bounds in space.items():
            low, high = _scale(name, bounds)
            good = Mixture([_place(name, done[i][0][name]) for i in best], low, high)
            bad = Mixture([_place(name, d[name]) for i, (d, _) in enumerate(done) if i not in best] + [_place(name, s[name]) for s in out], low, high)
            drawn = [good.draw(rng) for _ in range(CANDIDATES)]
            ratio = np.log(good.density(drawn)) - np.log(bad.density(drawn))
            setting[name] = _value(name, bounds, drawn[int(np.argmax(ratio))])
        out.append(setting)
    return out


def adaptive_search(
    score_all: Callable[[list[dict]], list[float]], space: dict, trials: int, first: Callable[[int], list[dict]], seed: int = 42,
    startup: int = STARTUP, batch: int = BATCH,
) -> list[tuple[dict, float]]:
    """``trials`` settings with their scores, in the order tried; ``score_all`` scores a batch, ``first`` gives the random ones."""
    rng = random.Random(seed)
    settings = first(min(startup, trials))
    done = list(zip(settings, score_all(settings)))
    while len(done) < trials:
        settings = propose(done, space, min(batch, trials - len(done)), rng)
        done += zip(settings, score_all(settings))
    return done
