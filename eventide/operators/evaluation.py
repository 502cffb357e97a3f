"""Metrics of predictions, strategies and model comparisons."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.definitions import HORIZON_ORDER
from eventide.operators.ordering import global_positions, running_sum


def strategy_return():
    """Long on a positive prediction, short otherwise (a prediction of 0 is short)."""
    return F.when(F.col("predicted") > 0, F.col("actual")).otherwise(-F.col("actual"))


def regression_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """r2, rmse, mae, directional accuracy and strategy Sharpe from (predicted, actual)."""
    p, a = F.col("predicted"), F.col("actual")
    s = strategy_return()
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum((a - p) * (a - p)).alias("sse"),
        F.var_pop(a).alias("var"), F.avg(F.abs(a - p)).alias("mae"),
        F.avg(((p > 0) == (a > 0)).cast("double")).alias("dir_acc"),
        F.avg(s).alias("m"), F.stddev_pop(s).alias("d"),
    )
    return sums.select(
        *by, "n",
        (1 - F.try_divide(F.col("sse"), F.col("var") * F.col("n"))).alias("r2"),
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mae", "dir_acc",
        F.when(F.col("d") > 0, F.col("m") / F.col("d") * math.sqrt(252 / 5)).otherwise(F.lit(0.0)).alias("sharpe"),
    )


def cumulative_strategy(df: DataFrame, order: list[str], model: str = "model") -> DataFrame:
    """Running strategy return per model in trade order."""
    placed = global_positions(df.withColumn("strategy", strategy_return()), [model, *order], "trades")
    return running_sum(placed, model, "strategy", "cumulative").drop("_pos")


def model_comparison(models: DataFrame, by: str = "horizon") -> DataFrame:
    """Models of a horizon by descending CV R²; a handful of rows per horizon."""
    w = Window.partitionBy(by).orderBy(F.desc("cv_r2"), F.asc("model"))
    return models.withColumn("place", F.row_number().over(w))


def best_horizon(models: DataFrame, order: list[str] = HORIZON_ORDER) -> DataFrame:
    """The horizon whose best model has the highest CV R²; the earlier horizon wins a tie."""
    place = F.array_position(F.array(*[F.lit(h) for h in order]), F.col("horizon"))
    best = models.groupBy("horizon").agg(F.max("cv_r2").alias("cv_r2"))
    return best.agg(F.max_by(F.struct("horizon", "cv_r2"), F.struct("cv_r2", -place)).alias("b")).select("b.*")


def blend_weights(weights: DataFrame) -> DataFrame:
    """Mean of ridge and lasso weights; a fifth of the ridge weight where lasso has none."""
    lasso = F.coalesce("lasso", F.lit(0.0))
    ridge = F.coalesce("ridge", F.lit(0.0))
    blended = F.when(lasso == 0, ridge * 0.2).otherwise((ridge + lasso) / 2)
    return weights.withColumn("_b", blended).where(F.abs("_b") > 0.001).withColumn(
        "weight", F.round("_b", 4)).drop("_b")


def top_weights(weights: DataFrame, k: int, by: str = "horizon") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(F.abs("weight")), F.asc("feature"))
    return weights.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
