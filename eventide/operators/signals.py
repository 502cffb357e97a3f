"""Per-feature predictive power: rank correlation, accuracy, signal returns, samples, combos."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.stats import ic_pvalue
from eventide.operators.ordering import cumulative_counts, distribution, quantile_columns
from eventide.operators.rankcorr import pairwise_spearman


def feature_ic(rows: DataFrame, features: dict[str, str], horizons: dict[str, str], min_n: int = 20) -> DataFrame:
    """(feature, horizon, n, ic) unrounded; ``features``/``horizons`` map name -> column."""
    pairs = [(f, h) for f in features.values() for h in horizons.values()]
    name = F.create_map(*[F.lit(v) for k, c in {**features, **horizons}.items() for v in (c, k)])
    return (
        pairwise_spearman(rows, pairs)
        .where(F.col("n") >= min_n)
        .select(name[F.col("left")].alias("feature"), name[F.col("right")].alias("horizon"), "n",
                F.col("r").alias("ic"))
    )


def with_pvalue(ic: DataFrame) -> DataFrame:
    return ic.withColumn("ic_pvalue", ic_pvalue("ic", "n"))


def score_groups(rows: DataFrame, features: dict[str, str], horizons: dict[str, str]) -> DataFrame:
    """Returns summed per distinct score: (feature, horizon, score, cnt, ..., sums and extremes).

    Scores take few distinct values, so this is the only pass over the events; accuracy, medians,
    quartiles and signal returns all follow from its rows.
    """
    counters, extras = {}, {}
    for h, col in horizons.items():
        r = F.col(col)
        counters[f"n_{h}"] = F.count(r)
        extras |= {
            f"s_{h}": F.sum(r), f"q_{h}": F.sum(r * r),
            f"up_{h}": F.count(F.when(r > 0, 1)), f"down_{h}": F.count(F.when(r < 0, 1)),
            f"lo_{h}": F.min(r), f"hi_{h}": F.max(r),
        }
    long = rows.select(
        *[F.col(c).cast("double").alias(f) for f, c in features.items()], *horizons.values()
    ).unpivot(list(horizons.values()), list(features), "feature", "score")
    counts = cumulative_counts(long, ["feature"], "score", counters, extras, label="scores")
    per_horizon = [
        F.struct(
            F.lit(h).alias("horizon"), F.col(f"n_{h}").alias("cnt"),
            F.col(f"n_{h}_before").alias("cnt_before"), F.col(f"n_{h}_total").alias("cnt_total"),
            *[F.col(f"{p}_{h}").alias(p) for p in ("s", "q", "up", "down", "lo", "hi")],
        )
        for h in horizons
    ]
    return (
        counts.select("feature", "score", F.explode(F.array(*per_horizon)).alias("h"))
        .select("feature", "score", "h.*").where("cnt > 0")
    )


def signal_stats(
    groups: DataFrame,
    bearish: set[str],
    mode: str = "fixed",
    small_n: str = "neutral",
    min_n: int = 20,
) -> DataFrame:
    """Accuracy and triggered-signal returns per (feature, horizon), unrounded.

    ``mode='fixed'`` predicts above 0.5 and triggers above 0.6; ``mode='quantile'`` predicts above
    the median and triggers above the upper quartile. With at most one triggered row,
    ``small_n='neutral'`` gives 0 / 0 / 0.5 and ``small_n='observed'`` keeps the observed win share.
    """
    key = ["feature", "horizon"]
    if mode == "fixed":
        cut = groups.withColumns({"predict": F.lit(0.5), "trigger": F.lit(0.6)})
    else:
        cuts = groups.groupBy(*key).agg(
            *quantile_columns("score", {"predict": 0.5, "trigger": 0.75})
        )
        cut = groups.join(F.broadcast(cuts), key)  # one row per feature and horizon
    bear = F.col("feature").isin(*bearish) if bearish else F.lit(False)
    hits = F.when(bear, F.col("down")).otherwise(F.col("up"))
    on = F.col("score") > F.col("trigger")

    def total(col):
        return F.coalesce(F.sum(F.when(on, col)), F.lit(0))

    sums = cut.groupBy(*key).agg(
        F.sum("cnt").alias("n"),
        F.sum(F.when(F.col("score") > F.col("predict"), hits).otherwise(F.col("cnt") - hits)).alias("right"),
        total(F.col("cnt")).alias("m"),
        total(F.when(bear, -F.col("s")).otherwise(F.col("s"))).alias("s"),
        total(F.col("q")).alias("q"),
        total(hits).alias("wins"),
        F.min(F.when(on, F.col("lo"))).alias("lo"),
        F.max(F.when(on, F.col("hi"))).alias("hi"),
    ).where(F.col("n") >= min_n)
    m = F.col("m")
    mean = F.try_divide(F.col("s"), m)
    variance = F.greatest(F.try_divide(F.col("q"), m) - mean * mean, F.lit(0.0))
    std = F.when(F.col("lo") < F.col("hi"), F.sqrt(variance)).otherwise(F.lit(0.0))
    enough = m > 1
    win = F.try_divide(F.col("wins"), m)
    return sums.select(
        *key,
        (F.col("right") / F.col("n")).alias("accuracy"),
        F.when(enough & (std > 0), mean / std * 2).otherwise(F.lit(0.0)).alias("sharpe"),
        F.when(enough, mean).otherwise(F.lit(0.0)).alias("avg_return_pct"),
        F.when(m > (1 if small_n == "neutral" else 0), win).otherwise(F.lit(0.5)).alias("win_rate"),
        F.col("n").alias("n_observations"),
        m.alias("n_signal_triggered"),
    )


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Round every double column half up; adding 0.0 turns -0.0 into 0.0."""
    return df.select(*[
        (F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


def feature_signal_table(
    rows: DataFrame,
    features: dict[str, str],
    horizons: dict[str, str],
    bearish: set[str],
    mode: str = "fixed",
    small_n: str = "neutral",
    min_n: int = 20,
) -> DataFrame:
    """The eight statistics of every feature and horizon, rounded to four places."""
    ic = with_pvalue(feature_ic(rows, features, horizons, min_n)).drop("n")
    stats = signal_stats(score_groups(rows, features, horizons), bearish, mode, small_n, min_n)
    return rounded(stats.join(ic, ["feature", "horizon"]))


def sample_extremes(
    rows: DataFrame, features: dict[str, str], keep: list[str], tie_break: list[str], k: int = 3
) -> DataFrame:
    """Top ``k`` then bottom ``k`` events per feature, in descending order of score.

    ``row_number <= k`` is limited per map task before the shuffle, so a feature's rows are not
    gathered in one task.
    """
    ids = list(dict.fromkeys([*tie_break, *keep]))
    long = rows.select(
        *ids, *[F.col(c).cast("double").alias(f) for f, c in features.items()]
    ).unpivot(ids, list(features), "feature", "score").where(F.col("score").isNotNull())
    by = Window.partitionBy("feature")
    top = by.orderBy(F.desc("score"), *tie_break)
    bottom = by.orderBy(F.asc("score"), *[F.desc(c) for c in tie_break])
    head = long.withColumn("place", F.row_number().over(top)).where(F.col("place") <= k)
    tail = long.withColumn("place", F.row_number().over(bottom)).where(F.col("place") <= k)
    return head.withColumn("side", F.lit("top")).unionByName(tail.withColumn("side", F.lit("bottom")))


def combo_signals(
    rows: DataFrame, combos: list, horizons: dict[str, str], min_rows: int = 15, min_triggered: int = 3
) -> DataFrame:
    """Signals that need several thresholds at once; all combos in one aggregation pass."""
    aggs, parts = [], []
    for i, (name, direction, terms) in enumerate(combos):
        complete = F.lit(True)
        signal = F.lit(True)
        for feature, threshold in terms:
            col = F.col(f"feat_{feature}")
            complete = complete & col.isNotNull()
            below = direction == "bullish" and threshold < 0.5
            signal = signal & ((col < threshold) if below else (col > threshold))
        for col in horizons.values():
            complete = complete & F.col(col).isNotNull()
        on = complete & signal
        aggs += [F.count_if(complete).alias(f"t{i}"), F.count_if(on).alias(f"m{i}")]
        for h, col in horizons.items():
            r = F.when(on, -F.col(col) if direction == "bearish" else F.col(col))
            aggs += [F.avg(r).alias(f"a{i}_{h}"), F.stddev_samp(r).alias(f"d{i}_{h}"),
                     F.avg((r > 0).cast("double")).alias(f"w{i}_{h}")]
            parts.append(F.struct(
                F.lit(name).alias("name"),
                F.array(*[F.lit(f) for f, _ in terms]).alias("features"),
                F.lit(h).alias("period"),
                F.col(f"a{i}_{h}").alias("avg"), F.col(f"d{i}_{h}").alias("std"),
                F.col(f"w{i}_{h}").alias("win"),
                F.col(f"m{i}").alias("n_triggered"), F.col(f"t{i}").alias("n_total"),
            ))
    long = rows.agg(*aggs).select(F.explode(F.array(*parts)).alias("c")).select("c.*")
    sharpe = F.when(F.col("std") > 0, F.col("avg") / F.col("std") * 2).otherwise(F.lit(0.0))
    return long.where((F.col("n_total") >= min_rows) & (F.col("n_triggered") >= min_triggered)).select(
        "name", "features", "period",
        F.round(sharpe, 3).alias("sharpe"), F.round("avg", 3).alias("avg_return"),
        F.round("win", 3).alias("win_rate"), "n_triggered", "n_total",
    )


def feature_summary(rows: DataFrame, features: dict[str, str]) -> DataFrame:
    """p25 / p50 / p75 (exact), mean and population deviation per feature."""
    long = rows.select(*[F.col(c).cast("double").alias(f) for f, c in features.items()]).unpivot(
        [], list(features), "feature", "value"
    )
    return distribution(long, ["feature"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}).drop("n")


def scaler_fit(rows: DataFrame, features: dict[str, str]) -> DataFrame:
    """(feature, n, mean, std) with the population deviation, 1.0 where it vanishes."""
    aggs = [F.struct(F.lit(f).alias("feature"), F.count(c).alias("n"), F.avg(c).alias("mean"),
                     F.stddev_pop(c).alias("std")) for f, c in features.items()]
    std = F.when(F.col("s.std") > 1e-9, F.col("s.std")).otherwise(F.lit(1.0))
    return rows.agg(F.array(*aggs).alias("all")).select(F.explode("all").alias("s")).select(
        "s.feature", "s.n", "s.mean", std.alias("std")
    )


def best_period(table: DataFrame, order: list[str]) -> DataFrame:
    """Per feature the horizon with the largest |IC|; the earlier horizon wins a tie."""
    place = F.array_position(F.array(*[F.lit(h) for h in order]), F.col("horizon"))
    best = F.max_by(F.struct(*[c for c in table.columns if c != "feature"]), F.struct(F.abs("ic"), -place))
    return table.where(F.col("ic").isNotNull()).groupBy("feature").agg(best.alias("b")).select("feature", "b.*")
