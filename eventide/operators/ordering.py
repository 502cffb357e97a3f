"""Exact ranks, positions, running totals and quantiles without a one-task window.

A window over one group (one feature, or the whole table) puts that group in one task. Here the
rows are first collapsed to distinct values where possible, then range-partitioned, so that a
group of any size is spread over many tasks; only the per-partition totals (at most partitions +
groups rows) are combined in a small window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.session import stage

POSITION = "_pos"


def _range_stage(df: DataFrame, order: list[str | Column], label: str) -> DataFrame:
    """Rows in range partitions of ``order``; ``_pid`` is increasing along the order.

    The table is written, so ``_pid`` stays the same however often a task is repeated.
    """
    spread = df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id())
    return stage(spread, label)


def global_positions(df: DataFrame, order: list[str], label: str = "positions") -> DataFrame:
    """Add ``_pos``: the 0-based place of each row in the total order ``order``.

    Rows are range-partitioned, sorted and numbered inside their partition while they are written,
    so a later pass only adds the partition's offset: a broadcast of one row per partition.
    """
    numbered = (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    placed = stage(numbered, label).withColumn("_pid", F.shiftright("_id", 33))
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(offsets), "_pid")
        .withColumn(POSITION, F.col("_off") + local)
        .drop("_pid", "_off", "_id")
    )


def running_sum(df: DataFrame, group: str, value: str, out: str, chunk: int = 100_000) -> DataFrame:
    """Running total of ``value`` per ``group`` along ``_pos``, in chunks of positions."""
    chunked = df.withColumn("_chunk", F.floor(F.col(POSITION) / chunk))
    totals = chunked.groupBy(group, "_chunk").agg(F.sum(value).alias("_t"))
    upto = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "_chunk", F.coalesce(F.sum("_t").over(upto), F.lit(0.0)).alias("_off"))
    inside = (
        Window.partitionBy(group, "_chunk").orderBy(POSITION)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        chunked.join(offsets, [group, "_chunk"])
        .withColumn(out, F.col("_off") + F.sum(value).over(inside))
        .drop("_chunk", "_off")
    )


def cumulative_counts(
    df: DataFrame,
    groups: list[str],
    value: str,
    counters: dict[str, Column] | None = None,
    extras: dict[str, Column] | None = None,
    label: str = "distinct",
) -> DataFrame:
    """One row per distinct (groups, value) with running counts inside the group.

    For each counter ``c`` (default: one counter ``cnt`` of all rows) the result has ``c``,
    ``c_before`` (rows of the group with a smaller value) and ``c_total``. ``extras`` are further
    aggregates kept per distinct value. Counting is combined map-side, so a value held by a third
    of all rows costs one row per task.
    """
    counters = counters or {"cnt": F.count(F.lit(1))}
    aggs = [c.alias(name) for name, c in {**counters, **(extras or {})}.items()]
    spread = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(*aggs)
    placed = _range_stage(spread, [*groups, value], label)

    sizes = placed.groupBy(*groups, "_pid").agg(*[F.sum(c).alias(f"{c}_t") for c in counters])
    group_w = Window.partitionBy(*groups)
    below = group_w.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *groups,
        "_pid",
        *[F.coalesce(F.sum(f"{c}_t").over(below), F.lit(0)).alias(f"{c}_off") for c in counters],
        *[F.sum(f"{c}_t").over(group_w).alias(f"{c}_total") for c in counters],
    )
    local = (
        Window.partitionBy("_pid", *groups).orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # offsets holds at most (range partitions + groups) rows
    joined = placed.join(F.broadcast(offsets), [*groups, "_pid"])
    for c in counters:
        joined = joined.withColumn(
            f"{c}_before", F.col(f"{c}_off") + F.coalesce(F.sum(c).over(local), F.lit(0))
        )
    return joined.drop("_pid", *[f"{c}_off" for c in counters])


def mid_rank(counter: str = "cnt") -> Column:
    """Average rank of a tied value, from the columns of ``cumulative_counts``."""
    return F.col(f"{counter}_before") + (F.col(counter) + 1) / F.lit(2.0)


def avg_rank(df: DataFrame, groups: list[str], value: str, out: str) -> DataFrame:
    """Add the tie-averaged rank of ``value`` inside its group (NULL stays NULL)."""
    ranks = cumulative_counts(df, groups, value).select(*groups, value, mid_rank().alias(out))
    return df.join(ranks, [*groups, value], "left")


def quantile_columns(value: str, quantiles: dict[str, float], counter: str = "cnt") -> list[Column]:
    """Aggregates that pick linearly interpolated quantiles out of ``cumulative_counts`` rows."""
    before, total = F.col(f"{counter}_before"), F.col(f"{counter}_total")
    upto = before + F.col(counter)
    out = []
    for name, q in quantiles.items():
        place = (total - 1) * F.lit(float(q))
        lo, hi = F.floor(place), F.ceil(place)
        v_lo = F.max(F.when((before <= lo) & (lo < upto), F.col(value)))
        v_hi = F.max(F.when((before <= hi) & (hi < upto), F.col(value)))
        share = F.max(place - lo)
        out.append((v_lo + (v_hi - v_lo) * share).alias(name))
    return out


def exact_quantiles(
    df: DataFrame, groups: list[str], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """Exact interpolated quantiles per group, from distributed running counts."""
    counts = cumulative_counts(df, groups, value)
    return counts.groupBy(*groups).agg(*quantile_columns(value, quantiles))


def distribution(
    df: DataFrame, groups: list[str], value: str, quantiles: dict[str, float], label: str = "values"
) -> DataFrame:
    """Per group: n, exact quantiles, mean and population deviation, from one pass over ``df``.

    Everything after the collapse to distinct values reads the staged counts only.
    """
    counts = cumulative_counts(df, groups, value, label=label)
    means = counts.groupBy(*groups).agg((F.sum(F.col(value) * F.col("cnt")) / F.sum("cnt")).alias("_mean"))
    gap = F.col(value) - F.col("_mean")
    # one row per group: groups are columns or horizons
    return counts.join(F.broadcast(means), groups).groupBy(*groups).agg(
        F.sum("cnt").alias("n"), *quantile_columns(value, quantiles), F.max("_mean").alias("mean"),
        F.sqrt(F.sum(F.col("cnt") * gap * gap) / F.sum("cnt")).alias("std"),
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key; a map-side ``min_by``, so hot keys are not collected."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return kept.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*df.columns)
