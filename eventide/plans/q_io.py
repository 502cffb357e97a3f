"""Queries that go through a source or a sink and read the result back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from eventide.definitions import FILING_RENAME, HORIZON_ORDER, KNOWN_FEATURES
from eventide.operators import cleaning, evaluation, rankcorr, signals, trees, views, zoo
from eventide.operators.scoring import rank_scores
from eventide.plans.oracle_tables import sql
from eventide.plans.q_models import ORDER
from eventide.plans.q_scoring import LABELS, WEIGHTS, hand_model, model_data, scored, scored_sql, univariate
from eventide.plans.q_signals import (BEARISH, FEATS, RETS, long_sql, pairs_sql, signal_table, staged, stats_sql)
from eventide.plans.registry import query
from eventide.session import new_path, stage
from eventide.sources import files
from eventide.sources import warehouse as wh

KEY = ["symbol", "quarter", "year"]
WHEN = dt.datetime(2025, 1, 2, 3, 4, 5)


@query("src_transcripts", sql(["transcripts"], "select ticker, quarter, year, md5(transcript) as digest, earnings_date from transcripts"))
def q_src_transcripts(spark, sf):
    path = new_path(spark, "transcripts")
    wh.transcripts(spark, sf).write.parquet(path)
    return files.read_transcripts(spark, path).select("ticker", "quarter", "year", F.md5("transcript").alias("digest"), "earnings_date")


@query("sink_transcripts", sql(["transcripts"], "select ticker as symbol, quarter, year, md5(transcript) as digest from transcripts"))
def q_sink_transcripts(spark, sf):
    path = new_path(spark, "transcripts")
    t = wh.transcripts(spark, sf).withColumnRenamed("ticker", "symbol")
    files.write_transcripts(t, path)
    files.write_transcripts(t.where("symbol = 'src1'"), path)  # replaces that folder only
    return spark.read.parquet(path).select(*KEY, F.md5("transcript").alias("digest"))


@query("src_analysis", sql(["scores"], """
  select symbol, quarter, year, feature, score, case n % 3 when 0 then 'prepared' when 1 then 'qa' else 'both' end as section from long
  union all select symbol, quarter, year, 'invented_extra', 0.5e0, 'qa' from scores""",
    long=long_sql("scores", {f: f for f in KNOWN_FEATURES}, "symbol, quarter, year, n")))
def q_src_analysis(spark, sf):
    path = new_path(spark, "analysis")
    files.write_json(wh.analysis(spark, sf), path)
    return cleaning.explode_features(files.read_analysis(spark, path), KEY).drop("evidence")


@query("src_filings_csv", sql(["filings"], f"select ticker, filingDate, {', '.join(FILING_RENAME)}, actual30dAlpha from filings"))
def q_src_filings(spark, sf):
    path = new_path(spark, "filings_csv")
    columns = [c.strip().split()[0] for c in files.FILING_SCHEMA.split(",")]
    files.write_csv(wh.filings(spark, sf).select(*columns), path)
    return files.read_csv(spark, path, files.FILING_SCHEMA).select("ticker", "filingDate", *FILING_RENAME, "actual30dAlpha")


_DATASET = [c.strip().split()[0] for c in files.BACKTEST_SCHEMA.split(",")]


@query("src_backtest_csv", sql(["dataset"], f"select {', '.join(_DATASET)} from dataset"))
def q_src_backtest(spark, sf):
    path = new_path(spark, "dataset_csv")
    files.write_csv(wh.dataset(spark, sf).select(*_DATASET), path)
    return files.read_csv(spark, path, files.BACKTEST_SCHEMA)


@query("sink_dataset_csv", sql(["dataset"], "select year, count(*) as n, count(return_21D) as mature, round(sum(return_5D), 3) + 0 as total from dataset group by year"))
def q_sink_dataset(spark, sf):
    path = new_path(spark, "dataset_csv")
    files.write_csv(wh.dataset(spark, sf).select(*_DATASET), path)
    back = files.read_csv(spark, path, files.BACKTEST_SCHEMA)
    return back.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count("return_21D").alias("mature"), (F.round(F.sum("return_5D"), 3) + 0.0).alias("total"))


@query("src_price_cache", sql(["returns"], "select symbol, quarter, year, event_date, " + ", ".join(f"return_{h}" for h in HORIZON_ORDER) + " from returns"))
def q_src_cache(spark, sf):
    path = new_path(spark, "price_cache")
    wh.price_cache(spark, sf).withColumn("last_updated", F.lit(WHEN)).write.parquet(path)
    return spark.read.parquet(path).select(*KEY, "event_date", *RETS.values())


MODEL_SQL = " union all ".join(
    f"select '{f}' as feature, {w}e0 as weight, m_{f} as mean, s_{f} as std, 0.3e0 as intercept from sc" for f, w in WEIGHTS.items() if w)


def _model_frame(spark, sf):
    path = new_path(spark, "model")
    files.write_model(hand_model(model_data(spark, sf)), spark, path)
    return path


@query("sink_model_json", scored_sql("select feature, weight, mean, std, intercept from m", m=MODEL_SQL))
def q_sink_model(spark, sf):
    saved = spark.read.schema(files.MODEL_SCHEMA).json(_model_frame(spark, sf))
    return saved.select("*", F.explode("weights").alias("feature", "weight")).where("weight <> 0").select(
        "feature", "weight", F.col("scaler_means")[F.col("feature")].alias("mean"), F.col("scaler_stds")[F.col("feature")].alias("std"), "intercept")


@query("src_model_json", scored_sql("select symbol, quarter, year, raw_score, signal, confidence from labeled"))
def q_src_model(spark, sf):
    """Scores of a model that went through its JSON file."""
    from eventide.operators.scoring import score_events

    data = model_data(spark, sf)
    path = new_path(spark, "model")
    files.write_model(hand_model(data), spark, path)
    return score_events(data, files.read_model(spark, path), KEY).select(*KEY, "raw_score", "signal", "confidence")


@query("sink_scores", scored_sql(f"select symbol, quarter, year, {LABELS}, row_number() over (order by raw_score desc, symbol, quarter, year) as place from labeled"))
def q_sink_scores(spark, sf):
    path = new_path(spark, "scores")
    files.write_json(rank_scores(scored(spark, sf), KEY).orderBy("place"), path)
    schema = "symbol string, quarter int, year int, raw_score double, expected_return_pct double, signal string, confidence string, percentile string, place bigint"
    return spark.read.schema(schema).json(path)


@query("sink_results_json", sql(["dataset"], "select feature, horizon, n_observations, n_signal_triggered from stats",
       pairs=pairs_sql("dataset", FEATS, RETS), stats=stats_sql(BEARISH)))
def q_sink_results(spark, sf):
    path = new_path(spark, "results")
    nested = files.nested_results(signal_table(spark, sf))
    nested.select("document").write.text(path)
    schema = "feature string, periods array<struct<horizon:string,n_observations:bigint,n_signal_triggered:bigint>>"
    back = spark.read.text(path).select(F.from_json("value", schema).alias("r"))
    return back.select("r.feature", F.explode("r.periods").alias("p")).select("feature", "p.*")


@query("sink_experiments", sql(["dataset"], "select h.horizon, h.n, r.run from (" + " union all ".join(
    f"select '{h}' as horizon, count({c}) as n from dataset" for h, c in RETS.items()) + ") h, (select unnest([1, 2]) as run) r"))
def q_sink_experiments(spark, sf):
    path = new_path(spark, "experiments")
    # one row, written once: both records would work the dataset out
    counts = stage(wh.dataset(spark, sf).agg(*[F.count(c).alias(h) for h, c in RETS.items()]), "counts").unpivot([], list(RETS), "horizon", "n")
    for run in (1, 2):
        files.append_experiment(counts.withColumn("run", F.lit(run)), path, WHEN + dt.timedelta(days=run))
    return spark.read.schema("horizon string, n bigint, run int").json(path)


@query("snapshot_before_refresh", sql(["returns_short", "returns"], """
  select 'before' as version, count(*) as n, count(return_21D) as mature from returns_short union all select 'after', count(*), count(return_21D) from returns"""))
def q_snapshot(spark, sf):
    path = new_path(spark, "price_cache")
    wh.price_cache(spark, sf, 30).write.parquet(path)
    backup = files.snapshot(spark, path, WHEN)
    wh.price_cache(spark, sf).write.mode("overwrite").parquet(path)
    count = lambda p, v: spark.read.parquet(p).agg(
        F.count(F.lit(1)).alias("n"), F.count("return_21D").alias("mature")).select(F.lit(v).alias("version"), "n", "mature")
    return count(backup, "before").unionByName(count(path, "after"))


@query("sink_report_md")
def q_report(spark, sf):
    data = staged(spark, sf)
    table = signals.feature_signal_table(data, FEATS, RETS, BEARISH)
    best = signals.best_period(table, HORIZON_ORDER)
    designs = {h: zoo.prepare(data, FEATS, c, ORDER) for h, c in RETS.items()}
    forests = trees.together([lambda d=d: trees.random_forest(d) for d in designs.values()], at_once=4)
    found = zoo.zoo_frame(spark, {h: zoo.linear_zoo(d) + f for (h, d), f in zip(designs.items(), forests)})
    models = evaluation.model_comparison(zoo.zoo_models(found))
    horizon = evaluation.best_horizon(models).first()["horizon"]
    weights = evaluation.blend_weights(zoo.zoo_blend_input(found)).where(F.col("horizon") == horizon)
    features = data.select("_row", *[F.col(c).alias(f) for f, c in FEATS.items()])
    notable = rankcorr.notable_correlations(rankcorr.correlation_matrix(features, KNOWN_FEATURES))
    meta = views.dataset_counts(data, "symbol", "earnings_date")
    return files.write_report(spark, files.report_lines(meta, best, models, weights, notable), new_path(spark, "report"))
