"""Boosting of many training sets at once against Spark ML's, fit by fit."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventide.operators import boosting, trees, walkforward, zoo
from eventide.operators.boosting import Fit

FEATURES = [f"f{i}" for i in range(4)]


def data(spark, n, places):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(np.round(rng.normal(size=(n, len(FEATURES))), places), columns=FEATURES)
    pdf["y"] = 2 * pdf["f0"] * pdf["f1"] - np.abs(pdf["f3"]) + rng.normal(size=n)
    pdf["day"] = [f"{i:06d}" for i in rng.permutation(n)]
    return spark.createDataFrame(pdf).repartition(3)


@pytest.fixture(scope="module")
def design(spark):
    return zoo.prepare(data(spark, 700, 1), {f: f for f in FEATURES}, "y", ["day"])


def test_trees_are_those_of_separate_fits(design, monkeypatch):
    monkeypatch.setattr(boosting, "TASK_ROWS", 200)
    monkeypatch.setattr(boosting, "RESTART", 3)
    kinds = [dict(maxIter=8, maxDepth=3, stepSize=0.2, minInstancesPerNode=5), dict(maxIter=5, maxDepth=2, stepSize=0.3), dict(maxIter=4, maxDepth=3, minInstancesPerNode=60)]
    fits = [Fit(end, **kind) for end, kind in zip((120, 430, 120), kinds)]
    model = boosting.fit_boosted(design, fits)
    assert [len(t) for t in model.trees] == [8, 5, 4]
    found = boosting.predict_boosted(design, model, [(k, f.end, 700) for k, f in enumerate(fits)], [boosting.POSITION]).toPandas()
    vectors = trees.assembled(design)
    for k, (fit, kind) in enumerate(zip(fits, kinds)):
        spark_ml = trees.boosted(**kind).fit(vectors.where(F.col("_pos") < fit.end)).transform(vectors.where(F.col("_pos") >= fit.end))
        want = spark_ml.toPandas().sort_values("_pos")
        mine = found[found["fit"] == k].sort_values("_pos")
        assert mine["_pos"].tolist() == want["_pos"].tolist() == list(range(fit.end, 700))
        assert np.allclose(mine["predicted"], want["prediction"], atol=1e-9)


def test_split_points_are_all_or_near_even_shares(spark):
    fine = zoo.prepare(data(spark, 3_000, 6), {f: f for f in FEATURES}, "y", ["day"])
    points = boosting.split_points(fine.rows, fine.columns, [100, 3_000], bins=16)
    rows = fine.rows.orderBy("_pos").toPandas()
    for end, of_set in points.items():
        for column, found in zip(fine.columns, of_set):
            values = np.sort(rows[column].to_numpy()[:end])
            at = np.searchsorted(values, found)
            assert len(found) == 15 and np.abs(at - end * np.arange(1, 16) / 16).max() <= 1
            assert np.allclose(found, (values[at - 1] + values[at]) / 2)


def test_drawn_rows_are_a_share_and_change_by_round(spark):
    position = np.arange(100_000)
    drawn = [boosting._drawn(position, r, 0.8) for r in (0, 1)]
    assert all(abs(d.mean() - 0.8) < 0.01 for d in drawn) and abs((drawn[0] & drawn[1]).mean() - 0.64) < 0.01


def test_passes_do_not_grow_with_fits(spark, design):
    """A refit of every expanding history takes no jobs of its own."""
    context, jobs = spark.sparkContext, {}
    for name, bounds in (("few", [(350, 700)]), ("many", [(k, k + 50) for k in range(50, 700, 50)])):
        context.setJobGroup(name, name)
        got = walkforward.walk_forward_boosted(design, trees.VARIANTS["XGBoost (default)"] | {"maxIter": 6}, ["day"], bounds).toPandas()
        jobs[name] = len(context.statusTracker().getJobIdsForGroup(name))
        assert sorted(got["_pos"]) == list(range(bounds[0][0], 700))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs["many"] <= jobs["few"] + 3


def test_walk_forward_without_rows_to_predict(spark):
    small = zoo.prepare(data(spark, 40, 1), {f: f for f in FEATURES}, "y", ["day"])
    assert walkforward.walk_forward_boosted(small, {"maxIter": 2}, ["day"]).count() == 0


def test_variants_have_r2_of_their_folds(design, monkeypatch):
    # nodes have rows enough that no two splits are equally good
    whole = {name: p | {"subsamplingRate": 1.0, "maxIter": 6, "minInstancesPerNode": 25 - 5 * (name[0] == "C")} for name, p in trees.VARIANTS.items()}
    monkeypatch.setattr(trees, "VARIANTS", whole)
    found = {(r[0], r[2]): r[3] for r in trees.boosted_variants(design)}
    vectors = trees.assembled(design)
    want = {name: trees.cross_validate(vectors, trees.boosted(**whole[name]), design.folds) for name in list(whole)[1:]}
    assert len(found) == 6 and found["XGBoost (default)", "r2_cv_mean"] == found["LightGBM (default)", "r2_cv_mean"]
    for name, r2 in want.items():
        assert (found[name, "r2_cv_mean"], found[name, "r2_cv_std"]) == pytest.approx(r2, abs=1e-9)
