"""Seconds per headline query: BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS], one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "forward_returns", "lookback_activity", "join_sources", "feature_signal_table", "feature_signal_table_filings",
    "corr_matrix", "combo_signals", "feature_percentiles", "sample_extremes", "mutual_information", "moment_blocks",
    "zoo_ridge", "zoo_lasso", "walk_forward", "score_all", "rank_scores", "alpha_score", "train_scoring_model",
    "clean_transcripts", "build_requests", "lexicon_density", "novelty_vs_prior", "stream_signal_counts",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from eventide.plans import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").limit(1).collect()  # start the session, not a query
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total seconds of headline queries, whole results computed", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": float(sf.group(1)) if sf else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
