"""Calendar from the data, missing values in moments, words in any script, streams in any batching."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.functions import text as X
from eventide.operators import moments, scoring
from eventide.sources import warehouse as wh
from eventide.streaming import flows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("months", [0, 1, -400, 700])
def test_every_line_item_before_an_event_is_counted(spark, tmp_path, months):
    folder = str(tmp_path)
    spark.read.parquet(f"{SF}/supplier.parquet").write.parquet(f"{folder}/supplier.parquet")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    lines.withColumn("l_shipdate", F.add_months("l_shipdate", months)).write.parquet(f"{folder}/lineitem.parquet")
    want = duckdb.sql(f"""
      with l as (select cast(l_shipdate as date) as d from '{folder}/lineitem.parquet/*.parquet')
      select count(*) from l, (select make_date(y, m, 15) as e from range(1900, 2100) r(y), (select unnest([2, 5, 8, 11]) as m) q) c
      where e > d and e <= d + 90""").fetchall()[0][0]
    scores = wh.feature_scores(spark, folder)
    assert scores.agg(F.sum("n")).first()[0] == want
    keys = wh.events(spark, folder).select("symbol", "quarter", "year")
    assert scores.join(keys, ["symbol", "quarter", "year"], "left_anti").count() == 0


def test_no_line_items_no_events(spark, tmp_path):
    folder = str(tmp_path)
    for t in ("supplier", "lineitem"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0 if t == "lineitem" else 5).write.parquet(f"{folder}/{t}.parquet")
    assert wh.events(spark, folder).count() == 0


@pytest.mark.parametrize("width", [3, 30])
def test_nan_is_missing_in_either_way_of_summing(spark, width):
    r = np.random.default_rng(width)
    x = np.round(r.normal(size=(40, width)), 3)
    x[r.random(x.shape) < 0.2] = np.nan
    rows = [(i % 2, *[None if np.isnan(v) and (i + j) % 2 else float(v) for j, v in enumerate(row)]) for i, row in enumerate(x)]
    names = [f"c{j}" for j in range(width)]
    df = spark.createDataFrame(rows, "block int, " + ", ".join(f"{n} double" for n in names))
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    for row in moments.sum_products(df, "block", names, pairs).collect():
        part = x[row["block"] :: 2]
        both = part[:, row["i"]] * part[:, row["j"]]
        assert row["n"] == (~np.isnan(both)).sum()
        assert abs(row["s"] - np.nansum(both)) < 1e-9


def test_words_in_any_script(spark):
    df = spark.createDataFrame([("El día más niño, déjà-vu: 3 Äpfel!",), ("",)], "t string")
    t = X.normalised(F.col("t"))
    assert [tuple(r) for r in df.select(X.words(t), X.hits(t, ["más", "vu"]), X.hits(t, ["a", "m"])).collect()] == [(8, 2, 0), (0, 0, 0)]


@pytest.mark.parametrize("files", [1, 8])
def test_first_seen_in_any_batching(spark, tmp_path, files):
    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "user_id", "event_type")
    folder = str(tmp_path / "in")
    events.repartitionByRange(files, "ts").write.parquet(folder)
    late = events.orderBy("ts").limit(30)  # an old file that comes again, at the end
    late.coalesce(1).write.mode("append").parquet(folder)
    stream = flows.first_seen(flows.file_stream(spark, folder, files_per_trigger=1), ["user_id", "event_type"])
    out = flows.drain(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).select("user_id", "event_type").collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, events.select("user_id", "event_type").distinct().collect()))


def test_scores_matching_ignores_unknown_values(spark):
    df = spark.createDataFrame([("LONG", "high"), ("SHORT", "low"), ("NEUTRAL", "low")], "signal string, confidence string")
    count = lambda **kw: scoring.scores_matching(df, **kw).count()
    assert (count(), count(signal="long"), count(confidence="LOW"), count(signal="short", confidence="low"), count(signal="up"), count(confidence="")) == (3, 1, 2, 1, 3, 3)


def test_experiment_record_holds_models_and_winner(spark, tmp_path):
    import datetime as dt

    from eventide.sources import files

    comparison = spark.createDataFrame([("OLS", -0.2), ("Lasso", 0.1), ("Ridge", 0.1)], "model string, cv_r2 double")
    walked = spark.createDataFrame([("Ridge", 9, 0.1, 0.5, 1.5, True), ("Forest", 9, 0.2, 0.6, 1.0, False)], "model string, n bigint, r2 double, dir_acc double, sharpe double, promoted boolean")
    importance = spark.createDataFrame([("a", 0.1), ("b", 0.4)], "feature string, mean_abs double")
    record = files.experiment_record("y", 50, comparison, walked, importance)
    path = str(tmp_path / "experiments")
    for day in (1, 2):
        files.append_experiment(record, path, dt.datetime(2025, 1, day))
    got = spark.read.schema(record.schema).json(path).collect()
    assert len(got) == 2 and got[0] == got[1]
    r = got[0]
    assert [m["model"] for m in r["cv_comparison"]] == ["Lasso", "Ridge", "OLS"] and [m["model"] for m in r["walk_forward"]] == ["Forest", "Ridge"]
    assert (r["target"], r["n_trials"], r["best_model"]["model"], r["best_model"]["sharpe"], r["n_predictions"]) == ("y", 50, "Ridge", 1.5, 9)
    assert [tuple(i) for i in r["importance"]] == [("b", 0.4), ("a", 0.1)]
