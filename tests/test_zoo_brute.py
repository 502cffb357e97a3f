"""Elastic net, stepwise, polynomial and the trained scoring model against direct fits over the rows themselves."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from eventide.definitions import ELASTICNET_GRID, LASSO_GRID, RIDGE_GRID
from eventide.operators import training, zoo

FEATURES = [f"f{i}" for i in range(10)]
FOLDS = 5


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(21)
    n = 230
    pdf = pd.DataFrame(rng.normal(size=(n, 10)) * rng.uniform(0.5, 5, 10) + rng.normal(size=10), columns=FEATURES)
    pdf["y"] = 0.8 * pdf["f0"] - 0.5 * pdf["f3"] * pdf["f4"] + 0.2 * pdf["f7"] + 2 * rng.normal(size=n)
    pdf["day"] = [f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}" for i in rng.permutation(n)]
    p = pdf.sort_values("day")
    x = p[FEATURES].to_numpy()
    return spark.createDataFrame(pdf).repartition(4), (x - x.mean(0)) / x.std(0), p["y"].to_numpy(), x


@pytest.fixture(scope="module")
def rows(data):
    return zoo.linear_zoo(zoo.prepare(data[0], {f: f for f in FEATURES}, "y", ["day"]))


def named(rows, model, kind):
    return {n: v for m, k, n, v in rows if m == model and k == kind}


def ridge(alpha):
    def fit(x, y):
        xm, ym = x.mean(0), y.mean()
        w = np.linalg.solve((x - xm).T @ (x - xm) + alpha * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
        return w, ym - xm @ w
    return fit


def net(alpha, l1):
    """Coordinate descent for 1/2n squared error + alpha * (l1 |w| + (1 - l1) / 2 w²)."""
    def fit(x, y):
        xm, ym, n = x.mean(0), y.mean(), len(y)
        z, r, w = x - xm, y - ym, np.zeros(x.shape[1])
        size = (z * z).sum(0) / n
        for _ in range(20_000):
            most = 0.0
            for j in range(len(w)):
                old = w[j]
                rho = z[:, j] @ r / n + size[j] * old
                w[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / (size[j] + alpha * (1 - l1))
                if w[j] != old:
                    r = r - z[:, j] * (w[j] - old)
                    most = max(most, abs(w[j] - old))
            if most < 1e-12:
                break
        return w, ym - xm @ w
    return fit


def cv(x, y, fit):
    size, scores = len(y) // (FOLDS + 1), []
    for i in range(FOLDS):
        a = len(y) - (FOLDS - i) * size
        w, b = fit(x[:a], y[:a])
        test = y[a : a + size]
        scores.append(1 - ((test - x[a : a + size] @ w - b) ** 2).sum() / ((test - test.mean()) ** 2).sum())
    return np.mean(scores), np.std(scores)


def best(x, y, grid, make):
    found = [(cv(x, y, make(*g) if isinstance(g, tuple) else make(g)), g) for g in grid]
    top = max(f[0][0] for f in found)
    return next((g, s) for s, g in found if s[0] == top)


def test_elastic_net(data, rows):
    _, x, y, _ = data
    (alpha, l1), (mean, _) = best(x, y, ELASTICNET_GRID, net)
    metrics = named(rows, "ElasticNet", "metric")
    assert metrics["r2_cv_mean"] == pytest.approx(mean, abs=1e-7) and (metrics["best_alpha"], metrics["best_l1_ratio"]) == (alpha, l1)
    w, _ = net(alpha, l1)(x, y)
    got = named(rows, "ElasticNet", "weight")
    assert got == {f: pytest.approx(v, abs=6e-5) for f, v in zip(FEATURES, w) if abs(v) > 1e-6}


def test_stepwise(data, rows):
    _, x, y, _ = data
    alpha, _ = best(x, y, RIDGE_GRID, ridge)
    chosen = []
    while len(chosen) < 8:
        rest = [j for j in range(10) if j not in chosen]
        chosen.append(max(rest, key=lambda j: (cv(x[:, [*chosen, j]], y, ridge(alpha))[0], -j)))
    added = named(rows, "Stepwise+Ridge", "added_at")
    assert sorted(added, key=added.get) == [FEATURES[j] for j in chosen]
    mean, std = cv(x[:, sorted(chosen)], y, ridge(alpha))
    metrics = named(rows, "Stepwise+Ridge", "metric")
    assert (metrics["r2_cv_mean"], metrics["r2_cv_std"]) == (pytest.approx(mean), pytest.approx(std))
    w, _ = ridge(alpha)(x[:, sorted(chosen)], y)
    assert named(rows, "Stepwise+Ridge", "weight") == {FEATURES[j]: pytest.approx(v, abs=6e-5) for j, v in zip(sorted(chosen), w)}


def test_polynomial(data, rows):
    _, x, y, _ = data
    (alpha, _), w = best(x, y, LASSO_GRID, lambda a: net(a, 1.0)), None
    w, _ = net(alpha, 1.0)(x, y)
    kept = [j for j in np.argsort(-np.abs(np.round(w, 4)), kind="stable") if abs(w[j]) > 1e-6][:6]
    columns, names = [x[:, j] for j in kept], [FEATURES[j] for j in kept]
    for i, a in enumerate(kept):
        columns.append(x[:, a] ** 2)
        names.append(f"{FEATURES[a]}^2")
        for b in kept[i + 1 :]:
            columns.append(x[:, a] * x[:, b])
            names.append(f"{FEATURES[a]} {FEATURES[b]}")
    terms = np.column_stack(columns)
    mean, std = cv(terms, y, ridge(10.0))
    metrics = named(rows, "Polynomial", "metric")
    assert (metrics["n_poly_features"], metrics["r2_cv_mean"], metrics["r2_cv_std"]) == (len(names), pytest.approx(mean), pytest.approx(std))
    v, _ = ridge(10.0)(terms, y)
    top = sorted(range(len(names)), key=lambda t: -abs(v[t]))[:12]
    assert named(rows, "Polynomial", "weight") == {names[t]: pytest.approx(v[t], abs=6e-5) for t in top}
    assert named(rows, "Polynomial", "interaction") == {n: pytest.approx(c, abs=6e-5) for n, c in zip(names, v) if " " in n and abs(c) > 0.01}


def test_scoring_model(data):
    df, x, y, raw = data
    grid = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0]
    model, _ = training.train_scoring_model(df, {f: f for f in FEATURES}, "y", ["day"], grid, "5D", trained_at=dt.datetime(2025, 1, 1))
    alpha, (mean, _) = best(x, y, grid, lambda a: net(a, 1.0))
    w, b = net(alpha, 1.0)(x, y)
    assert (model.lasso_alpha, model.cv_r2, model.n_training_samples) == (alpha, pytest.approx(mean, abs=6e-5), len(y))
    assert model.weights == {f: pytest.approx(v, abs=2e-6) for f, v in zip(FEATURES, w)} and model.intercept == pytest.approx(b, abs=2e-6)
    assert [model.means[f] for f in FEATURES] == pytest.approx(list(raw.mean(0)), abs=2e-6) and [model.stds[f] for f in FEATURES] == pytest.approx(list(raw.std(0)), abs=2e-6)
    fitted = x @ w + b
    for p in (10, 25, 50, 75, 90):
        assert model.score_percentiles[f"p{p}"] == pytest.approx(np.percentile(fitted, p), abs=1e-4)
    for j, f in enumerate(FEATURES):
        assert [model.feature_percentiles[f][f"p{p}"] for p in (25, 50, 75)] == pytest.approx(list(np.percentile(raw[:, j], (25, 50, 75))), abs=1e-4)
