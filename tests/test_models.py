import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from eventide import session
from eventide.definitions import ALPHA_MODEL
from eventide.operators import alpha, evaluation, moments, scoring, solvers, training, trees, walkforward, zoo
from eventide.sources import files

FEATURES = [f"f{i}" for i in range(10)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 260
    pdf = pd.DataFrame(rng.normal(size=(n, len(FEATURES))), columns=FEATURES)
    pdf["f9"] = pdf["f0"] - pdf["f1"]  # an exact linear dependence, as net counts have
    pdf["y"] = 2 * pdf["f0"] - pdf["f3"] + rng.normal(size=n)
    pdf["day"] = [f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}" for i in rng.permutation(n)]
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.fixture(scope="module")
def design(data):
    return zoo.prepare(data[1], {f: f for f in FEATURES}, "y", ["day"])


def ordered(pdf):
    p = pdf.sort_values("day").reset_index(drop=True)
    x = p[FEATURES].to_numpy()
    return (x - x.mean(0)) / x.std(0), p["y"].to_numpy()


def split(n, k):
    size = n // (k + 1)
    return [(np.arange(0, n - (k - i) * size), np.arange(n - (k - i) * size, n - (k - i - 1) * size)) for i in range(k)]


def ridge_direct(x, y, alpha):
    xm, ym = x.mean(0), y.mean()
    w = np.linalg.solve((x - xm).T @ (x - xm) + alpha * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
    return w, ym - xm @ w


def test_folds_are_ordered_and_disjoint(design, data):
    got = design.rows.groupBy("_block").agg(F.min("_pos").alias("lo"), F.max("_pos").alias("hi")).orderBy("_block").collect()
    n = len(data[0])
    tests = [(t[0], t[-1]) for _, t in split(n, 5)]
    assert [(r["lo"], r["hi"]) for r in got][1:] == tests and got[0]["lo"] == 0
    assert zoo.fold_count(30) == 2 and zoo.fold_count(70) == 3 and zoo.fold_count(10_000) == 5


def test_moment_models_equal_direct_fits(design, data):
    x, y = ordered(data[0])
    blocks = zoo.fold_moments(design)
    for a in (0.1, 10.0):
        w, b = solvers.weights_and_intercept(sum(blocks), solvers.ridge(a))
        w0, b0 = ridge_direct(x, y, a)
        np.testing.assert_allclose(w, w0, atol=1e-9)
        scores = []
        for tr, te in split(len(y), 5):
            wi, bi = ridge_direct(x[tr], y[tr], a)
            e = y[te] - x[te] @ wi - bi
            scores.append(1 - (e @ e) / ((y[te] - y[te].mean()) ** 2).sum())
        cv = solvers.cross_validate(blocks, solvers.ridge(a))
        assert cv["mean"] == pytest.approx(np.mean(scores)) and cv["std"] == pytest.approx(np.std(scores))
        assert b == pytest.approx(b0)


def test_lasso_meets_its_optimality_conditions(design, data):
    x, y = ordered(data[0])
    whole, n = sum(zoo.fold_moments(design)), len(y)
    for a, l1 in ((0.001, 1.0), (0.1, 1.0), (0.5, 0.3)):
        w, b = solvers.weights_and_intercept(whole, solvers.elastic_net(a, l1))
        grad = x.T @ (y - x @ w - b) / n - a * (1 - l1) * w
        assert np.all(np.abs(grad[w == 0]) <= a * l1 + 1e-8)
        np.testing.assert_allclose(grad[w != 0], a * l1 * np.sign(w[w != 0]), atol=1e-8)
    assert not np.any(solvers.weights_and_intercept(whole, solvers.lasso(1e3))[0])


def test_both_moment_paths_agree(design, monkeypatch):
    names = [*design.columns, "y"]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    rows = {}
    for limit in (10_000, 0):
        monkeypatch.setattr(moments, "MAX_BUILTIN_PRODUCTS", limit)
        out = moments.sum_products(design.rows, "_block", names, pairs).collect()
        rows[limit] = {(r["_block"], r["i"], r["j"]): (r["n"], r["s"]) for r in out}
    assert rows[0].keys() == rows[10_000].keys()
    for k, (n, s) in rows[0].items():
        assert rows[10_000][k][0] == n and rows[10_000][k][1] == pytest.approx(s, abs=1e-9)


def test_zoo_tables(spark, design):
    found = zoo.zoo_frame(spark, {"5D": zoo.linear_zoo(design)})
    models = evaluation.model_comparison(zoo.zoo_models(found)).orderBy("place").collect()
    assert {m["model"] for m in models} == {"OLS", "Ridge", "Lasso", "ElasticNet", "Stepwise+Ridge", "Polynomial"}
    assert models[0]["cv_r2"] == max(m["cv_r2"] for m in models)
    added = found.where("kind = 'added_at'").orderBy("value").collect()
    assert len(added) == 8 and added[0]["name"] == "f0"
    blend = {r["feature"]: r["weight"] for r in evaluation.blend_weights(zoo.zoo_blend_input(found)).collect()}
    assert blend["f0"] > 0 > blend["f3"]


def test_walk_forward_matches_refits(design, data):
    x, y = ordered(data[0])
    for chunk in (500, 3):
        got = walkforward.walk_forward_ridge(design, ["day"], batches_per_chunk=chunk).toPandas().sort_values("_pos")
        want = np.concatenate([
            x[s:s + 10] @ ridge_direct(x[:s], y[:s], 1.0)[0] + ridge_direct(x[:s], y[:s], 1.0)[1] for s in range(50, len(y), 10)])
        assert got["_pos"].tolist() == list(range(50, len(y)))
        np.testing.assert_allclose(got["predicted"], want, atol=1e-8)


def test_trees_find_the_driver(design):
    out = {(k, n): v for _, k, n, v in trees.random_forest(design, trees=5)}
    imp = {n: v for (k, n), v in out.items() if k == "importance"}
    assert max(imp, key=imp.get) in ("f0", "f9")
    drops = dict(trees.permutation_importance(design, trees.forest(5).fit(trees.assembled(design))))
    assert max(drops, key=drops.get) in ("f0", "f9")
    assert trees.random_settings(3) == trees.random_settings(3)


def test_forest_in_small_passes_is_the_same(design, monkeypatch):
    whole = trees.forest(30)
    monkeypatch.setattr(trees, "TASK_ROWS", design.n - 1)
    parts = trees.forest(30, rows=design.n)
    assert parts.getMaxMemoryInMB() == trees.PASS_MB < whole.getMaxMemoryInMB()
    vectors = trees.assembled(design).coalesce(1)
    one, other = whole.fit(vectors), parts.setMaxMemoryInMB(1).fit(vectors)
    np.testing.assert_allclose(one.featureImportances.toArray(), other.featureImportances.toArray(), atol=1e-12)
    assert [t.numNodes for t in one.trees] == [t.numNodes for t in other.trees]


def make_model():
    cuts = {"p10": -2.0, "p25": -1.0, "p50": 0.0, "p75": 1.0, "p90": 2.0}
    return scoring.ScoringModel(["a", "b", "c"], {"a": 0.5, "b": -0.25, "c": 0.0}, 0.1, {"a": 1.0, "b": 2.0, "c": 0.0},
                                {"a": 2.0, "b": 4.0, "c": 1.0}, cuts)


def test_scores_of_means_gaps_and_boundaries(spark):
    m = make_model()
    rows = [("mean", 1.0, 2.0), ("plus", 3.0, 2.0), ("gap", None, 6.0), ("none", None, None)]
    df = spark.createDataFrame(rows, "k string, a double, b double").withColumn("c", F.lit(None).cast("double"))
    got = {r["k"]: r for r in scoring.score_events(df, m, ["k"], prefix="").collect()}
    assert got["mean"]["raw_score"] == 0.1 and got["plus"]["raw_score"] == 0.6
    assert got["gap"]["raw_score"] == -0.15 and got["none"]["raw_score"] == 0.1
    assert [tuple(c) for c in got["gap"]["feature_contributions"]] == [("b", -0.25)]
    assert scoring.score_events(df, m, ["k"], prefix="", skip_empty=True).count() == 3
    edge = spark.createDataFrame([(v,) for v in (-2.0, -1.0, -0.5, 0.0, 1.0, 2.0)], "s double").select(
        scoring.signal_label(F.col("s"), m.score_percentiles), scoring.confidence_label(F.col("s"), m.score_percentiles),
        scoring.percentile_label(F.col("s"), m.score_percentiles)).collect()
    assert [tuple(r) for r in edge] == [
        ("SHORT", "high", "10-25th"), ("SHORT", "medium", "25-50th"), ("NEUTRAL", "low", "25-50th"),
        ("NEUTRAL", "low", "50-75th"), ("LONG", "medium", "75-90th"), ("LONG", "high", ">90th")]


def test_trained_model_survives_its_file(spark, data):
    model, design = training.train_scoring_model(
        data[1], {f: f for f in FEATURES}, "y", ["day"], [0.01, 0.1, 1.0], "1D", trained_at=dt.datetime(2025, 1, 1))
    path = session.new_path(spark, "model")
    files.write_model(model, spark, path)
    assert files.read_model(spark, path) == model
    assert model.n_training_samples == len(data[0]) and model.weights["f3"] < 0
    assert model.feature_percentiles["f0"]["p50"] == pytest.approx(np.median(data[0]["f0"]))


def test_alpha_model_at_its_means(spark):
    cols = [F.lit(mean).alias(f) for f, (_, mean, _) in ALPHA_MODEL.items()]
    row = alpha.trade_rules(alpha.alpha_score(spark.range(1).select(*cols))).first()
    assert row["raw_score"] == 0.0 and row["signal"] == "NEUTRAL" and row["predicted_30d_return"] == 0.8
    assert (row["action"], row["size"], row["target_pct"]) == ("HOLD", 0.0, None)
    up = spark.range(1).select(*cols).withColumn("price_to_low", F.col("price_to_low") + 0.4174 * 2)
    row = alpha.trade_rules(alpha.alpha_score(up)).first()
    assert row["raw_score"] == 2.6382 and row["confidence"] == "high" and row["action"] == "BUY" and row["stop_pct"] == -5.0


def test_zero_prediction_counts_as_short(spark):
    df = spark.createDataFrame([("m", 0.0, 2.0), ("m", 1.0, 3.0), ("m", -1.0, -1.0)], "model string, predicted double, actual double")
    r = evaluation.regression_metrics(df, ["model"]).first()
    s = np.array([-2.0, 3.0, 1.0])
    assert r["sharpe"] == pytest.approx(s.mean() / s.std() * np.sqrt(252 / 5))
    flat = evaluation.regression_metrics(df.withColumn("actual", F.lit(1.0)), ["model"]).first()
    assert flat["r2"] is None


def test_paging_and_ties(spark):
    df = spark.createDataFrame([(f"s{i}", float(i % 3), "LONG", "high") for i in range(9)], "symbol string, raw_score double, signal string, confidence string")
    page = scoring.scores_page(scoring.scores_matching(df, "long", "nonsense"), ["symbol"], 3, 2).collect()
    assert [r["symbol"] for r in page] == ["s8", "s1", "s4"]
    assert scoring.scores_matching(df, "SHORT").count() == 0


class FakeSession:
    """The parts of a session that name the shared folder."""

    def __init__(self, master, folder=None):
        self.sparkContext = self.conf = self
        self.master, self.folder, self.applicationId = master, folder, "fake"

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" else default


def test_shared_folder_is_the_named_one(spark):
    assert session.shared_dir(FakeSession("yarn", "hdfs://shared/ckpt/")) == "hdfs://shared/ckpt"
    with pytest.raises(RuntimeError):
        session.shared_dir(FakeSession("yarn"))
    assert session.stage(spark.range(3), "x").count() == 3


def test_staged_scores_equal_separate_fits(spark, data):
    design = zoo.prepare(data[1], {f: f for f in FEATURES}, "y", ["day"])
    vectors = trees.assembled(design)
    train, test = vectors.where("_block < 5"), vectors.where("_block = 5")
    kind = dict(maxDepth=2, stepSize=0.2, subsamplingRate=0.8)
    curve = trees.staged_r2(trees.boosted(maxIter=6, **kind).fit(train), test)
    judge = RegressionEvaluator(metricName="r2")
    for rounds in (1, 3, 6):
        assert curve[rounds - 1] == pytest.approx(judge.evaluate(trees.boosted(maxIter=rounds, **kind).fit(train).transform(test)), abs=1e-9)
    best, (mean, std) = trees.best_rounds(vectors, trees.boosted(maxIter=6, **kind), design.folds, least=2)
    means = {r: trees.cross_validate(vectors, trees.boosted(maxIter=r, **kind), design.folds) for r in (2, 6)}
    assert 2 <= best <= 6 and mean >= max(m for m, _ in means.values()) - 1e-9
    if best in means:
        assert (mean, std) == pytest.approx(means[best])


def test_fits_side_by_side_keep_order_and_properties(spark):
    context = spark.sparkContext
    context.setLocalProperty("callSite.short", "outer")
    got = trees.together([lambda i=i: (i, spark.range(10 * i).count(), context.getLocalProperty("callSite.short")) for i in range(7)], at_once=3)
    context.setLocalProperty("callSite.short", None)
    assert got == [(i, 10 * i, "outer") for i in range(7)] and trees.together([]) == []


def test_refits_predict_every_row_from_earlier_ones(spark, data):
    assert walkforward.refit_bounds(40) == [] and walkforward.refit_bounds(51) == [(50, 51)]
    bounds = walkforward.refit_bounds(10_000)
    assert bounds[0][0] == 50 and bounds[-1][1] == 10_000 and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:])) and len(bounds) < 16
    design = zoo.prepare(data[1], {f: f for f in FEATURES}, "y", ["day"])
    seen = []

    def fit(train):
        mean, last = train.agg(F.avg("y"), F.max("_pos")).first()
        seen.append(last)
        return lambda test: test.withColumn("prediction", F.lit(mean))

    got = walkforward.walk_forward_estimator(design, fit, ["day"]).toPandas().sort_values("_pos")
    assert got["_pos"].tolist() == list(range(50, design.n)) and sorted(seen) == [a - 1 for a, _ in walkforward.refit_bounds(design.n)]
    y = design.rows.orderBy("_pos").toPandas()["y"].to_numpy()
    for a, b in walkforward.refit_bounds(design.n):
        assert np.allclose(got["predicted"].to_numpy()[a - 50 : b - 50], y[:a].mean())
