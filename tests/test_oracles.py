"""Registered queries against DuckDB. EVENTIDE_ALL=1 runs every query, not only the quick ones."""

import os

import pytest

import __spark_entry__ as entry
import compare

PLACES = {"combo_signals": 3, "view_combos": 3, "corr_matrix": 3}
SF = "/root/testdata/sf0.001"
QUICK = [
    "feature_signal_table", "corr_matrix", "combo_signals", "signal_stats_combined", "sample_extremes", "best_period",
    "clean_transcripts", "parse_response", "median_impute", "refresh_due", "asof_backward", "forward_returns",
    "lookback_activity", "score_events", "signal_counts", "cumulative_strategy", "alpha_score", "accuracy_report",
    "ts_split", "moment_blocks", "moment_blocks_wide", "zoo_ridge_two_features", "mutual_information",
    "novelty_vs_prior", "src_analysis", "sink_transcripts", "stream_signal_counts", "stream_mature_returns",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("EVENTIDE_ALL") else QUICK


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    problem, n = compare.compare(compare.connect(SF), entry.queries()[name](spark, SF), entry.oracle_sql()[name], places=PLACES.get(name, 4))
    assert problem is None, problem


def test_every_query_is_named_in_both_or_rows_only():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "ic" in df.columns
