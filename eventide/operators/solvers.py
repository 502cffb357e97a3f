"""Small solvers on collected moment matrices (features x features, one per fold)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Fit = Callable[[np.ndarray, np.ndarray, float], np.ndarray]


def centred(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Row count, means and centred cross-products of a moment matrix over [1, x..., y]."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    return n, mean, m[1:, 1:] - n * np.outer(mean, mean)


def ols(sxx: np.ndarray, sxy: np.ndarray, n: float) -> np.ndarray:
    return np.linalg.lstsq(sxx, sxy, rcond=1e-12)[0]


def ridge(alpha: float) -> Fit:
    return lambda sxx, sxy, n: np.linalg.solve(sxx + alpha * np.eye(len(sxy)), sxy)


def elastic_net(alpha: float, l1_ratio: float, steps: int = 2_000) -> Fit:
    """Minimiser of 1/(2n)·RSS + α·l1·|w| + α·(1-l1)/2·w², by feature-sign search.

    The set of non-zero coefficients and their signs grows one feature at a time; for given signs
    the minimiser is a linear system, and a step stops where a coefficient would change its sign.
    """

    def fit(sxx: np.ndarray, sxy: np.ndarray, n: float) -> np.ndarray:
        l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
        g, c = sxx / n + l2 * np.eye(len(sxy)), sxy / n
        slack = 1e-10 * max(1.0, float(np.abs(c).max(initial=0.0)))

        def loss(v: np.ndarray) -> float:
            return float(0.5 * v @ g @ v - c @ v + l1 * np.abs(v).sum())

        w, signs = np.zeros(len(c)), np.zeros(len(c))
        for _ in range(steps):
            grad = g @ w - c
            off = np.where(w == 0, np.abs(grad), 0.0)
            settled = np.all(np.abs(grad + l1 * signs)[w != 0] <= slack)
            if settled:
                j = int(np.argmax(off)) if len(off) else 0
                if not len(off) or off[j] <= l1 + slack:
                    break
                signs[j] = -np.sign(grad[j])
            on = np.flatnonzero(signs)
            target = np.zeros_like(w)
            target[on] = np.linalg.lstsq(g[np.ix_(on, on)], c[on] - l1 * signs[on], rcond=1e-12)[0]
            move = target - w
            turns = [t for t in (-w[on] / np.where(move[on] == 0, np.inf, move[on])) if 0 < t < 1]
            points = [w + t * move for t in (*turns, 1.0)]
            best = min(points, key=loss)
            if loss(best) >= loss(w) - 1e-15 * abs(loss(w)):
                break
            w = np.where(np.abs(best) <= 1e-14 * np.abs(best).max(initial=0.0), 0.0, best)
            signs = np.sign(w)
        return w

    return fit


def lasso(alpha: float) -> Fit:
    return elastic_net(alpha, 1.0)


def weights_and_intercept(m: np.ndarray, fit: Fit) -> tuple[np.ndarray, float]:
    n, mean, s = centred(m)
    w = fit(s[:-1, :-1], s[:-1, -1], n)
    return w, float(mean[-1] - mean[:-1] @ w)


def squared_error(m: np.ndarray, w: np.ndarray, b: float) -> float:
    u = np.concatenate(([-b], -w, [1.0]))
    return float(u @ m @ u)


def r2(m: np.ndarray, w: np.ndarray, b: float) -> float | None:
    """R² on the rows behind ``m``; None when the target does not vary there."""
    total = centred(m)[2][-1, -1]
    if total <= 1e-12 * max(m[-1, -1], 1e-300):
        return None
    return 1.0 - squared_error(m, w, b) / total


def subset(m: np.ndarray, features: list[int]) -> np.ndarray:
    keep = [0, *[f + 1 for f in features], len(m) - 1]
    return m[np.ix_(keep, keep)]


def cross_validate(blocks: list[np.ndarray], fit: Fit) -> dict[str, float]:
    """Time-series CV: block i is tested with a model of all earlier blocks."""
    scores, errors = [], []
    train = np.zeros_like(blocks[0])
    for i in range(1, len(blocks)):
        train = train + blocks[i - 1]
        w, b = weights_and_intercept(train, fit)
        scores.append(r2(blocks[i], w, b))
        errors.append(squared_error(blocks[i], w, b) / blocks[i][0, 0])
    known = [s for s in scores if s is not None]
    return {
        "mean": float(np.mean(known)) if known else float("-inf"),
        "std": float(np.std(known)) if known else 0.0,
        "rmse": float(np.sqrt(np.mean(errors))),
    }


def best_of(blocks: list[np.ndarray], candidates: list, make: Callable[..., Fit]):
    """The first candidate with the strictly highest mean CV score."""
    best, top = None, {"mean": -np.inf}
    for c in candidates:
        score = cross_validate(blocks, make(*c) if isinstance(c, tuple) else make(c))
        if score["mean"] > top["mean"] or best is None:
            best, top = c, score
    return best, top


def forward_selection(blocks: list[np.ndarray], k: int, fit: Fit) -> list[int]:
    """Indices in the order they were added, each time the best mean CV score."""
    p = len(blocks[0]) - 2
    chosen: list[int] = []
    while len(chosen) < k:
        rest = [j for j in range(p) if j not in chosen]
        scores = [cross_validate([subset(m, [*chosen, j]) for m in blocks], fit)["mean"] for j in rest]
        chosen.append(rest[int(np.argmax(scores))])
    return chosen
