"""Tree ensembles of the zoo on Spark ML, with the same time-ordered folds."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.operators.boosting import Fit, fit_boosted, predict_boosted
from eventide.operators.zoo import MIN_ROWS_TREES, Design, fold_rows
from eventide.operators.ordering import POSITION
from eventide.operators.search import adaptive_search
from eventide.session import stage

# Forest and boosting settings per source.
FOREST = {"earnings": {"maxDepth": 5, "minInstancesPerNode": 5}, "filings": {"maxDepth": 3, "minInstancesPerNode": 10}}
BOOST_GRID = {
    "earnings": {"maxIter": 200, "minInstancesPerNode": 5, "depths": [2, 3, 4]},
    "filings": {"maxIter": 100, "minInstancesPerNode": 10, "depths": [2, 3]},
}
BOOST_RATES = [0.01, 0.05, 0.1]
# The three default boosting variants.
VARIANTS = {
    "XGBoost (default)": {"maxIter": 300, "maxDepth": 3, "stepSize": 0.05, "subsamplingRate": 0.8, "minInstancesPerNode": 5},
    "LightGBM (default)": {"maxIter": 300, "maxDepth": 3, "stepSize": 0.05, "subsamplingRate": 0.8, "minInstancesPerNode": 5},
    "CatBoost (default)": {"maxIter": 300, "maxDepth": 3, "stepSize": 0.05, "subsamplingRate": 0.8},
}
# Search ranges (low, high) of the tuned boosting models.
SEARCH = {"maxIter": (100, 500), "maxDepth": (2, 6), "stepSize": (0.01, 0.2), "subsamplingRate": (0.6, 1.0),
          "minInstancesPerNode": (1, 10)}


#: Tree fits are chains of small Spark jobs, which leave a cluster idle one by one: so many of them run at a time.
CONCURRENT = 12
#: Rows per task of a fit: each level of each tree is a job, so tasks should have work.
TASK_ROWS = 50_000
#: MB of counts that a pass over the rows fills. A forest's counts of a whole level leave the processor's caches, and every row
#: touches all of them; where there are rows enough, more passes over fewer nodes take half the time. The trees are the same.
PASS_MB = 2


def together(tasks: list[Callable[[], Any]], at_once: int = CONCURRENT) -> list:
    """Results of tasks that start Spark jobs, side by side and in the tasks' order; the caller's job properties go along.

    Where the cluster schedules jobs by FAIR pools, each task has one of its own.
    """
    session = SparkSession.active()

    def run(numbered: tuple[int, Callable[[], Any]]) -> Any:
        session.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{numbered[0] % at_once}")
        return numbered[1]()

    with ThreadPoolExecutor(max(1, min(at_once, len(tasks)))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(session)(run), t) for t in enumerate(tasks)]]


def assembled(design: Design) -> DataFrame:
    """Feature vectors, staged once for all folds and settings, with rows of all folds in every partition."""
    vectors = VectorAssembler(inputCols=design.columns, outputCol="features")
    rows = vectors.transform(design.rows).select(POSITION, "_block", "features", F.col("y").alias("label"))
    return stage(rows.repartition(-(-design.n // TASK_ROWS) or 1, POSITION), "vectors")


def forest(trees: int = 200, source: str = "earnings", rows: int = 0) -> RandomForestRegressor:
    """The forest of a source; with more than ``TASK_ROWS`` rows its nodes are split in passes of ``PASS_MB``."""
    passes = {"maxMemoryInMB": PASS_MB} if rows > TASK_ROWS else {}
    return RandomForestRegressor(numTrees=trees, featureSubsetStrategy="all", seed=42, maxBins=128, **passes, **FOREST[source])


def boosted(**params) -> GBTRegressor:
    return GBTRegressor(seed=42, maxBins=128, featureSubsetStrategy="all", **params)


def cross_validate_all(vectors: DataFrame, estimators: list, folds: int) -> list[tuple[float, float]]:
    """Mean and population deviation of R² over the time-ordered folds, per estimator; all fits run side by side."""
    judge = RegressionEvaluator(metricName="r2")

    def fit(estimator, i: int) -> Callable[[], float]:
        return lambda: judge.evaluate(estimator.fit(vectors.where(F.col("_block") < i)).transform(vectors.where(F.col("_block") == i)))

    scores = together([fit(e, i) for e in estimators for i in range(1, folds + 1)])
    return [mean_and_deviation(scores[k * folds : (k + 1) * folds]) for k in range(len(estimators))]


def mean_and_deviation(scores: list[float]) -> tuple[float, float]:
    mean = sum(scores) / len(scores)
    return mean, math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))


def cross_validate(vectors: DataFrame, estimator, folds: int) -> tuple[float, float]:
    """Mean and population deviation of R² over the time-ordered folds."""
    return cross_validate_all(vectors, [estimator], folds)[0]


def staged_r2(model, test: DataFrame) -> list[float]:
    """R² of a boosted model on ``test`` after 1, 2, ... of its rounds; each is what a fit of so many rounds gives."""
    spread = test.agg(F.var_pop("label")).first()[0]
    return [1 - mse / spread if spread else 0.0 for mse in model.evaluateEachIteration(test, "squared")]


def best_rounds(vectors: DataFrame, estimator: GBTRegressor, folds: int, least: int = 1) -> tuple[int, tuple[float, float]]:
    """Rounds with the best mean R² over the folds, of at least ``least``, and that R²: one fit per fold tells of all of them."""
    fold = lambda i: lambda: staged_r2(estimator.fit(vectors.where(F.col("_block") < i)), vectors.where(F.col("_block") == i))
    curves = together([fold(i) for i in range(1, folds + 1)])
    by_rounds = list(zip(*curves))[least - 1 :]
    best = max(range(len(by_rounds)), key=lambda k: (sum(by_rounds[k]), -k))
    return best + least, mean_and_deviation(list(by_rounds[best]))


def _result(name: str, model: Model, features: list[str], metrics: dict) -> list[tuple]:
    out = [(name, "metric", k, float(v)) for k, v in metrics.items()]
    return out + [(name, "importance", f, round(float(v), 4)) for f, v in zip(features, model.featureImportances)]


def random_forest(design: Design, trees: int = 200, source: str = "earnings") -> list[tuple]:
    if design.n < MIN_ROWS_TREES:
        return []
    vectors, est = assembled(design), forest(trees, source, design.n)
    mean, std = cross_validate(vectors, est, design.folds)
    return _result("Random Forest", est.fit(vectors), design.features, {"r2_cv_mean": mean, "r2_cv_std": std})


def gradient_boosting(
    design: Design, source: str = "earnings", trees: int | None = None,
    rates: list[float] = BOOST_RATES, depths: list[int] | None = None,
) -> list[tuple]:
    """Best of the rate x depth grid by mean CV R², refitted on all rows."""
    if design.n < MIN_ROWS_TREES:
        return []
    grid = BOOST_GRID[source]
    vectors = assembled(design)
    settings = [boosted(maxIter=trees or grid["maxIter"], stepSize=rate, maxDepth=depth, subsamplingRate=0.8, minInstancesPerNode=grid["minInstancesPerNode"])
                for rate in rates for depth in depths or grid["depths"]]
    scores = cross_validate_all(vectors, settings, design.folds)
    top = max(range(len(settings)), key=lambda k: (scores[k][0], -k))
    best = settings[top]
    metrics = {"best_learning_rate": best.getStepSize(), "best_max_depth": best.getMaxDepth(),
               "r2_cv_mean": scores[top][0], "r2_cv_std": scores[top][1]}
    return _result("Gradient Boost", best.fit(vectors), design.features, metrics)


def boosted_variants(design: Design, trees: int | None = None) -> list[tuple]:
    """CV R² of the named default settings; equal settings are fitted once, and the folds of all settings in the same passes."""
    settings = {name: {**p, "maxIter": trees or p["maxIter"]} for name, p in VARIANTS.items()}
    distinct = {repr(sorted(p.items())): p for p in settings.values()}
    folds = [fold_rows(design.n, design.folds, i) for i in range(1, design.folds + 1)]
    fits = [Fit(first, **p) for p in distinct.values() for first, _ in folds]
    tests = [(k, *folds[k % design.folds]) for k in range(len(fits))]
    scored = predict_boosted(design, fit_boosted(design, fits), tests, ["y"]).groupBy("fit").agg(
        (1 - F.sum((F.col("y") - F.col("predicted")) ** 2) / (F.var_pop("y") * F.count("y"))).alias("r2"))
    scores = [s for _, s in sorted(scored.collect())]  # one row per fit
    found = {name: mean_and_deviation(scores[k * design.folds : (k + 1) * design.folds]) for k, name in enumerate(distinct)}
    out = []
    for name, p in settings.items():
        mean, std = found[repr(sorted(p.items()))]
        out += [(name, "metric", "r2_cv_mean", mean), (name, "metric", "r2_cv_std", std)]
    return out


def random_settings(trials: int, space: dict = SEARCH, seed: int = 42) -> list[dict]:
    """Seeded draws: integers uniform, the step size log-uniform, the rest uniform."""
    rng = random.Random(seed)
    draws = []
    for _ in range(trials):
        d = {}
        for name, (lo, hi) in space.items():
            if isinstance(lo, int):
                d[name] = rng.randint(lo, hi)
            elif name == "stepSize":
                d[name] = math.exp(rng.uniform(math.log(lo), math.log(hi)))
            else:
                d[name] = rng.uniform(lo, hi)
        draws.append(d)
    return draws


def param_search(design: Design, trials: int = 50, space: dict = SEARCH, seed: int = 42, adaptive: bool = True) -> list[tuple]:
    """Search over boosting settings, adaptive or at random; each trial's settings and mean CV R². Batches are fitted side by side."""
    vectors = assembled(design)

    def score_all(settings: list[dict]) -> list[float]:
        return [mean for mean, _ in cross_validate_all(vectors, [boosted(**p) for p in settings], design.folds)]

    first = lambda n: random_settings(n, space, seed)
    found = adaptive_search(score_all, space, trials, first, seed) if adaptive else list(zip(first(trials), score_all(first(trials))))
    out = []
    for i, (params, mean) in enumerate(found, 1):
        out += [(f"trial {i}", "setting", k, float(v)) for k, v in params.items()]
        out.append((f"trial {i}", "metric", "r2_cv_mean", mean))
    return out


def permutation_importance(design: Design, model, seed: int = 42) -> list[tuple]:
    """Drop of R² when one feature is taken from another row.

    The other row is found by shifting positions by one seeded offset: one equality join for all
    features instead of a shuffle per feature.
    """
    offset = random.Random(seed).randrange(1, max(design.n, 2))
    judge = RegressionEvaluator(metricName="r2")
    source = design.rows.select(((F.col(POSITION) + offset) % design.n).alias(POSITION),
                                *[F.col(c).alias(f"s_{c}") for c in design.columns])
    both = stage(design.rows.select(POSITION, *design.columns, F.col("y").alias("label")).join(source, POSITION), "shifted")

    def score(columns: list[str]) -> float:
        vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(both)
        return judge.evaluate(model.transform(vectors))

    base = score(design.columns)
    return [(f, base - score([f"s_{c}" if c == f"z_{f}" else c for c in design.columns])) for f in design.features]
