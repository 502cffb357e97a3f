"""Binned mutual information and linear explanations of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.operators.ordering import cumulative_counts
from eventide.operators.scoring import ScoringModel, contribution, live_features


def equal_frequency_edges(rows: DataFrame, columns: list[str], bins: int) -> dict[str, list[tuple[int, float]]]:
    """Per column the (bin, lowest value) pairs; equal values always share a bin."""
    long = rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "x")
    counts = cumulative_counts(long, ["column"], "x", label="bins")
    lowest = counts.groupBy(
        "column", F.floor(F.col("cnt_before") * bins / F.col("cnt_total")).cast("int").alias("bin")
    ).agg(F.min("x").alias("x"))
    out: dict[str, list[tuple[int, float]]] = {c: [] for c in columns}
    for r in lowest.collect():  # at most bins rows per column
        out[r["column"]].append((r["bin"], r["x"]))
    return {c: sorted(edges) for c, edges in out.items()}


def _bin(column: str, edges: list[tuple[int, float]]):
    col = F.col(column).cast("double")
    place = F.lit(None).cast("int")
    for number, low in edges:
        place = F.when(col >= F.lit(low), F.lit(number)).otherwise(place)
    return F.when(col.isNotNull(), place)


def mutual_information(
    rows: DataFrame, features: dict[str, str], horizons: dict[str, str], bins: int = 10
) -> DataFrame:
    """(feature, horizon, n, mi) in nats over equal-frequency bins of the complete pairs.

    Rows are binned with literal edges in a projection and counted map-side; only the joint counts
    (bins² per pair of columns) are shuffled.
    """
    edges = equal_frequency_edges(rows, [*features.values(), *horizons.values()], bins)
    binned = rows.select(
        *[_bin(c, edges[c]).alias(f) for f, c in features.items()],
        *[_bin(c, edges[c]).alias(f"h_{h}") for h, c in horizons.items()],
    )
    names = [f"h_{h}" for h in horizons]
    joint = (
        binned.unpivot(names, list(features), "feature", "bx").where("bx is not null")
        .unpivot(["feature", "bx"], names, "horizon", "by").where("by is not null")
        .groupBy("feature", "horizon", "bx", "by").agg(F.count(F.lit(1)).alias("c"))
    )
    pair = ["feature", "horizon"]
    total = F.sum("c").over(Window.partitionBy(*pair))
    nx = F.sum("c").over(Window.partitionBy(*pair, "bx"))
    ny = F.sum("c").over(Window.partitionBy(*pair, "by"))
    parts = joint.withColumns({"n": total, "part": F.col("c") / total * F.log(F.col("c") * total / (nx * ny))})
    return parts.groupBy("feature", F.substring("horizon", 3, 10).alias("horizon")).agg(
        F.max("n").alias("n"), F.sum("part").alias("mi"))


def linear_explanation(rows: DataFrame, model: ScoringModel, prefix: str = "feat_") -> DataFrame:
    """(feature, mean_abs): the mean absolute contribution of each feature, exact for linear models."""
    aggs = [F.struct(F.lit(f).alias("feature"),
                     F.avg(F.abs(contribution(model, f, F.col(prefix + f)))).alias("mean_abs"))
            for f in live_features(model)]
    return rows.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("s")).select("s.*")
