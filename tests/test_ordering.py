import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from eventide.operators import ordering, rankcorr
from eventide.functions.stats import correlation_pvalue, incomplete_beta


def frame(spark, n=500, seed=3, parts=7):
    rng = np.random.default_rng(seed)
    v = np.where(rng.random(n) < 0.4, 0.5, np.round(rng.random(n), 2))  # one value holds a third of the rows
    pdf = pd.DataFrame({"k": rng.permutation(n), "g": np.where(rng.random(n) < 0.8, "hot", "cold"), "v": v, "w": rng.normal(size=n)})
    return pdf, spark.createDataFrame(pdf).repartition(parts)


def test_positions_do_not_depend_on_partitions(spark):
    pdf, df = frame(spark)
    want = pdf.sort_values(["v", "k"])["k"].tolist()
    for parts in (1, 5):
        got = ordering.global_positions(df.repartition(parts), ["v", "k"]).orderBy("_pos").collect()
        assert [r["_pos"] for r in got] == list(range(len(pdf)))
        assert [r["k"] for r in got] == want


def test_running_sum_over_chunks(spark):
    pdf, df = frame(spark)
    placed = ordering.global_positions(df, ["k"])
    got = ordering.running_sum(placed, "g", "w", "total", chunk=16).select("k", "total").toPandas().sort_values("k")
    want = pdf.sort_values("k").groupby("g")["w"].cumsum()
    np.testing.assert_allclose(got["total"].to_numpy(), want.to_numpy(), atol=1e-9)


def test_ranks_and_quantiles(spark):
    pdf, df = frame(spark)
    got = ordering.avg_rank(df, ["g"], "v", "r").toPandas().sort_values("k")
    want = pdf.sort_values("k").groupby("g")["v"].rank()
    np.testing.assert_allclose(got["r"].to_numpy(), want.to_numpy())
    q = {"a": 0.1, "b": 0.25, "c": 0.5, "d": 0.9}
    for r in ordering.exact_quantiles(df, ["g"], "w", q).collect():
        part = pdf[pdf.g == r["g"]]["w"]
        for name, share in q.items():
            assert abs(r[name] - np.percentile(part, share * 100)) < 1e-12


def test_first_per_key(spark):
    pdf, df = frame(spark)
    got = ordering.first_per_key(df, ["g"], [F.col("k")]).toPandas().set_index("g")["k"].to_dict()
    assert got == pdf.groupby("g")["k"].min().to_dict()


def test_pairwise_spearman_with_gaps_ties_and_constants(spark):
    rng = np.random.default_rng(1)
    n = 300
    pdf = pd.DataFrame({"a": np.round(rng.random(n), 1), "b": rng.normal(size=n), "c": rng.normal(size=n), "k": 1.0})
    pdf.loc[rng.random(n) < 0.2, "a"] = None
    pdf.loc[rng.random(n) < 0.3, "c"] = None
    pdf["d"] = pdf["b"] * 0.5 + pdf["c"].fillna(0)
    sdf = spark.createDataFrame(pdf).select(*[F.when(F.isnan(x), None).otherwise(F.col(x)).alias(x) for x in pdf])
    pairs = [(x, y) for i, x in enumerate("abcdk") for y in "abcdk"[i + 1:]]
    got = {(r["left"], r["right"]): (r["n"], r["r"]) for r in rankcorr.pairwise_spearman(rankcorr.with_row_id(sdf), pairs).collect()}
    for x, y in pairs:
        both = pdf[[x, y]].dropna()
        n_xy, r = got[(x, y)]
        assert n_xy == len(both)
        if "k" in (x, y):
            assert r is None
        else:
            ranks = both.rank()
            assert abs(r - np.corrcoef(ranks[x], ranks[y])[0, 1]) < 1e-12


def test_spearman_ignores_monotone_transforms(spark):
    _, df = frame(spark, n=200)
    one = rankcorr.with_row_id(df.select("v", "w"))
    two = rankcorr.with_row_id(df.select("v", F.exp("w").alias("w")))
    r = [rankcorr.pairwise_spearman(x, [("v", "w")]).first()["r"] for x in (one, two)]
    assert abs(r[0] - r[1]) < 1e-12


def test_spearman_is_the_same_with_ranks_sent_or_fetched(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(float(rng.integers(0, 7)) if rng.random() < 0.8 else None, float(rng.normal()), None if rng.random() < 0.1 else float(rng.integers(0, 90))) for _ in range(400)]
    df = rankcorr.with_row_id(spark.createDataFrame(rows, "a double, b double, c double"))
    pairs = [("a", "b"), ("a", "c"), ("b", "c")]
    found = []
    for most in (0, 150, 100_000):  # all columns travel, only b does, none does
        monkeypatch.setattr(rankcorr, "MAX_BROADCAST_RANKS", most)
        found.append({(r["left"], r["right"]): (r["n"], round(r["r"], 12)) for r in rankcorr.pairwise_spearman(df, pairs).collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) == 3


def test_pvalues():
    assert abs(incomplete_beta(2.0, 3.0, 0.4) - 0.5248) < 1e-12
    assert abs(correlation_pvalue(0.5, 20) - 0.0247695) < 1e-6
    assert correlation_pvalue(1.0, 50) == 0.0
    assert abs(correlation_pvalue(0.0, 1_000_000) - 1.0) < 1e-12
    assert 0 < correlation_pvalue(0.002, 1_000_000) < 0.05
