"""File sources and sinks: CSV, JSON, partitioned parquet, model artifacts and reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.definitions import FILING_RENAME, FILING_TARGETS, HORIZON_ORDER, KNOWN_FEATURES
from eventide.functions.columns import stars
from eventide.operators.scoring import MODEL_SCHEMA, ScoringModel
from eventide.operators.views import ranked

FILING_SCHEMA = "ticker string, filingDate string, " + ", ".join(
    f"{c} double" for c in [*FILING_RENAME, *FILING_TARGETS.values()])
BACKTEST_SCHEMA = (
    "symbol string, quarter int, year int, earnings_date string, n bigint, "
    + ", ".join(f"feat_{f} double" for f in KNOWN_FEATURES) + ", "
    + ", ".join(f"return_{h} double" for h in [*HORIZON_ORDER, "earnings_day"]))
ANALYSIS_SCHEMA = (
    "symbol string, quarter int, year int, "
    "features map<string,struct<score:double,evidence:string,section:string>>, "
    "qa_vs_prepared_summary string, most_notable_signal string")
TRANSCRIPT_SCHEMA = "ticker string, year int, quarter int, transcript string, earnings_date string"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRANSCRIPT_SCHEMA).parquet(path)


def write_transcripts(df: DataFrame, path: str) -> None:
    """One folder per symbol; only the folders of the written symbols are replaced.

    ``rebalance`` splits a symbol with many rows over several files instead of one task.
    """
    (df.hint("rebalance", "symbol").write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path))


def read_analysis(spark: SparkSession, path: str, glob: str = "*.json", multi_line: bool = False) -> DataFrame:
    """Analyses; a missing symbol is the file name up to the first underscore."""
    df = spark.read.schema(ANALYSIS_SCHEMA).option("pathGlobFilter", glob).option("multiLine", multi_line).json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^([^_]+)_", 1)
    return df.withColumn("symbol", F.coalesce("symbol", stem))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a declared schema; columns are taken by header name."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_model(model: ScoringModel, spark: SparkSession, path: str) -> None:
    write_json(model.to_frame(spark).coalesce(1), path)


def read_model(spark: SparkSession, path: str) -> ScoringModel:
    return ScoringModel.from_frame(spark.read.schema(MODEL_SCHEMA).option("multiLine", False).json(path))


def nested_results(table: DataFrame) -> DataFrame:
    """(feature, document): the statistics of a feature as one JSON document."""
    stats = [c for c in table.columns if c not in ("feature",)]
    packed = table.groupBy("feature").agg(F.sort_array(F.collect_list(F.struct(*stats))).alias("periods"))
    return packed.select("feature", F.to_json(F.struct("feature", "periods")).alias("document"))


def append_experiment(record: DataFrame, path: str, when: dt.datetime) -> None:
    """Add a record to the experiment table, and keep a standalone copy of it."""
    stamped = record.withColumn("run_date", F.lit(when))
    write_json(stamped, path, "append")
    write_json(stamped, f"{path}_{when:%Y%m%d_%H%M%S}")


def experiment_record(target: str, trials: int, comparison: DataFrame, walked: DataFrame, importance: DataFrame) -> DataFrame:
    """One row of an experiment: models by CV R², walk-forward metrics per model, the promoted one, and feature importance.

    ``comparison`` (model, cv_r2), ``walked`` (model, n, r2, dir_acc, sharpe, promoted) and ``importance`` (feature, mean_abs)
    have a row per model or feature.
    """
    packed = lambda df, name, order, *columns: df.agg(
        F.array_sort(F.collect_list(F.struct(order.alias("place"), F.struct(*columns).alias("row")))).alias(name)
    ).select(F.transform(name, lambda x: x["row"]).alias(name))
    metrics = [F.col(c) for c in ("r2", "dir_acc", "sharpe")]
    best = walked.where("promoted").agg(F.first(F.struct("model", *metrics)).alias("best_model"), F.max("n").alias("n_predictions"))
    parts = [
        packed(comparison, "cv_comparison", F.struct(-F.col("cv_r2"), F.col("model")), "model", "cv_r2"),
        packed(walked, "walk_forward", F.struct(F.col("model")), "model", *metrics),
        packed(importance, "importance", F.struct(-F.col("mean_abs"), F.col("feature")), "feature", "mean_abs"),
        best,
    ]
    row = comparison.sparkSession.range(1).select(F.lit(target).alias("target"), F.lit(trials).alias("n_trials"), F.lit(0).alias("_one"))
    for part in parts:  # one row each
        row = row.join(part.withColumn("_one", F.lit(0)), "_one")
    return row.drop("_one")


def snapshot(spark: SparkSession, table_path: str, when: dt.datetime) -> str:
    """Copy of a table under a time-stamped path, taken before it is rebuilt."""
    backup = f"{table_path}_backup_{when:%Y%m%d_%H%M%S}"
    spark.read.parquet(table_path).write.parquet(backup)
    return backup


def report_lines(
    meta: DataFrame, best: DataFrame, models: DataFrame, weights: DataFrame, notable: DataFrame, top: int = 6,
) -> list[str]:
    """Markdown summary of the result tables; each has a row per feature, horizon or pair of features."""
    m = meta.first()
    lines = ["# Signal results", "",
             f"Dataset: {m['total_events']} events, {m['companies']} companies, {m['first_date']} to {m['last_date']}",
             "", "## Strongest features", ""]
    strongest = ranked(best, [F.desc(F.abs("ic")), F.asc("feature")]).where(F.col("place") <= top)
    for r in strongest.withColumn("stars", stars(F.col("ic_pvalue"))).orderBy("place").collect():
        lines.append(f"- **{r['feature']}**: IC={r['ic']:.3f} at {r['horizon']}, accuracy={r['accuracy']:.1%}, p={r['ic_pvalue']:.3f} {r['stars']}".rstrip())
    lines += ["", "## Best model by horizon", ""]
    winners = models.where("place = 1").orderBy("horizon").collect()
    lines += [f"- **{r['horizon']}**: {r['model']} (CV R²={r['cv_r2']:.4f})" for r in winners]
    lines += ["", "## Weights", ""]
    for r in weights.orderBy(F.desc(F.abs("weight")), "feature").collect():
        lines.append(f"- {r['feature']}: **{r['weight']:+.4f}** ({'bullish' if r['weight'] > 0 else 'bearish'})")
    pairs = notable.orderBy(F.desc(F.abs("r")), "f1", "f2").collect()
    if pairs:
        lines += ["", "## Redundant features", ""] + [f"- {r['f1']} / {r['f2']}: r={r['r']:.2f}" for r in pairs]
    lines += ["", "## Caveats", ""]
    n = m["total_events"]
    if n < 100:
        lines.append(f"- Small sample ({n} events): results may not generalise.")
    if n < 200:
        lines.append(f"- Test folds are very small with {n} events.")
    lines.append("- No transaction costs, slippage or market impact; only companies that still report are covered.")
    return lines


def write_report(spark: SparkSession, lines: list[str], path: str) -> DataFrame:
    schema = T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("value", T.StringType())])
    df = spark.createDataFrame(list(enumerate(lines, 1)), schema).coalesce(1)
    df.orderBy("line_no").select("value").write.mode("overwrite").text(path)
    return df
