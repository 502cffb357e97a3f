import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventide.definitions import COMBOS, LEXICONS
from eventide.functions import columns as C
from eventide.functions import text as X
from eventide.operators import cleaning, documents, joins, signals
from eventide.operators.returns import forward_returns

D = dt.date


def bars_frame(spark, rows):
    return spark.createDataFrame(rows, "symbol string, date date, close double")


def brute_returns(events, bars, days_after):
    out = {}
    for s, e in events:
        w = sorted((d, c) for sym, d, c in bars if sym == s and e - dt.timedelta(5) <= d < e + dt.timedelta(days_after + 10))
        after = [(d, c) for d, c in w if d >= e]
        if len(w) < 5 or len(after) < 2:
            continue
        base = after[0][1]
        r = {h: round((after[k][1] - base) / base * 100, 4) if len(after) > k else None for h, k in (("1D", 1), ("5D", 5), ("10D", 10), ("21D", 21))}
        before = [c for d, c in w if d < e]
        r["earnings_day"] = round((base - before[-1]) / before[-1] * 100, 4) if before else None
        out[(s, e)] = r
    return out


def test_forward_returns_match_brute_force(spark):
    rng = np.random.default_rng(5)
    days = [D(2024, 1, 1) + dt.timedelta(int(i)) for i in range(200)]
    bars = [("DAILY", d, 100.0 + i) for i, d in enumerate(days) if d.weekday() < 5]
    bars += [("SPARSE", d, float(rng.integers(50, 90))) for d in days if rng.random() < 0.15]
    bars += [("FOUR", days[i], 10.0 + i) for i in (10, 11, 12, 13)]
    events = [(s, days[i]) for s in ("DAILY", "SPARSE", "FOUR", "NONE") for i in (0, 4, 6, 7, 11, 60, 61, 62, 120, 160, 196, 199)]
    ev = spark.createDataFrame(events, "symbol string, event_date date")
    for days_after in (30, 90):
        want = brute_returns(events, bars, days_after)
        got = {(r["symbol"], r["event_date"]): r for r in forward_returns(ev, bars_frame(spark, bars), days_after).collect()}
        assert set(got) == set(want)
        for k, r in want.items():
            for h, v in r.items():
                assert got[k][f"return_{h}"] == (None if v is None else pytest.approx(v, abs=1e-9))


def test_forward_returns_order_bars_once_while_narrow(spark):
    ev = spark.createDataFrame([("A", D(2024, 1, 2))], "symbol string, event_date date")
    found = forward_returns(ev, bars_frame(spark, [("A", D(2024, 1, i), 1.0 * i) for i in range(1, 28)]), 30)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and found.count() == 1


def test_asof_and_lookback_match_brute_force(spark):
    rng = np.random.default_rng(6)
    day = lambda: D(2024, 1, 1) + dt.timedelta(int(rng.integers(0, 90)))
    acts = [("HOT" if rng.random() < 0.7 else "COLD", day(), rng.choice(["UBS Group", "Citi", "Other"]).item(),
             rng.choice(["upgrade", "downgrade", "maintain"]).item()) for _ in range(400)]
    evs = list({("HOT" if rng.random() < 0.7 else "COLD", day()) for _ in range(60)})
    got = joins.lookback_activity(
        spark.createDataFrame(evs, "symbol string, event_date date"),
        spark.createDataFrame(acts, "symbol string, activity_date date, firm string, action_type string"), ["UBS", "Citi"]).collect()
    assert len(got) == len(evs)
    for r in got:
        w = [a for a in acts if a[0] == r["symbol"] and r["event_date"] - dt.timedelta(30) <= a[1] < r["event_date"]]
        assert r["upgrades_last_30d"] == sum(a[3] == "upgrade" for a in w)
        assert r["major_downgrades_last_30d"] == sum(a[3] == "downgrade" and a[2] != "Other" for a in w)
    bars = bars_frame(spark, [("HOT", D(2024, 1, 1), 1.0), ("HOT", D(2024, 1, 4), 2.0)])
    back = {r["event_date"].day: r["prev_close"] for r in joins.asof_backward(
        spark.createDataFrame([("HOT", D(2024, 1, i)) for i in (1, 2, 4, 5, 9, 10)], "symbol string, event_date date"), bars).collect()}
    assert back == {1: None, 2: 1.0, 4: 1.0, 5: 2.0, 9: 2.0, 10: None}


def test_small_sample_rules(spark):
    rows = [(i, 0.5 if i else 0.9, float(i - 7)) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, feat_x double, return_5D double")
    run = lambda d, **kw: signals.signal_stats(signals.score_groups(d, {"x": "feat_x"}, {"5D": "return_5D"}), set(), **kw).collect()
    one = run(df)[0]
    assert (one["sharpe"], one["avg_return_pct"], one["win_rate"], one["n_signal_triggered"]) == (0.0, 0.0, 0.5, 1)
    assert run(df, mode="quantile", small_n="observed")[0]["win_rate"] == 0.0
    assert run(df.where("i > 0")) == [] and len(run(df.where("i > 0"), min_n=15)) == 1
    same = df.withColumn("return_5D", F.lit(0.1)).withColumn("feat_x", F.lit(0.9))
    assert run(same)[0]["sharpe"] == 0.0


def test_combos_need_three_triggers(spark):
    name, direction, terms = COMBOS[0]
    cols = [f for f, _ in terms]
    rows = [(0.9 if i < 3 else 0.1, 0.9, float(i), -float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, f"feat_{cols[0]} double, feat_{cols[1]} double, return_5D double, return_10D double")
    out = {r["period"]: r for r in signals.combo_signals(df, [COMBOS[0]], {"5D": "return_5D", "10D": "return_10D"}).collect()}
    assert out["5D"]["n_triggered"] == 3 and out["5D"]["avg_return"] == -1.0 and out["5D"]["sharpe"] == -2.0
    assert out["10D"]["win_rate"] == pytest.approx(0.667)
    fewer = df.where("return_5D > 0")
    assert signals.combo_signals(fewer, [COMBOS[0]], {"5D": "return_5D", "10D": "return_10D"}).collect() == []


def test_responses_keys_and_dates(spark):
    good = '{"features": {"mgmt_hedging": {"score": 0.4, "evidence": "x", "section": "qa"}, "odd": 3, "extra": {"score": 1}}}'
    texts = [good, f"```json\n{good}\n```", f"```\n{good}", f"{good}```", "{not json", f"  {good}\n", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = cleaning.parse_responses(df).orderBy("i").collect()
    assert [r["valid"] for r in got] == [True, True, True, True, False, True, False]
    assert set(got[1]["features"]) == {"mgmt_hedging", "extra"} and got[3]["features"]["mgmt_hedging"]["score"] == 0.4
    ids = ["AAPL_Q3_2023", "BRK_Q_Q3_2023", "AAPL_3_2023", "AAPL_Q3"]
    parts = spark.createDataFrame([(i,) for i in ids], "c string").select(*C.custom_id_parts(F.col("c"))).collect()
    assert [tuple(r) for r in parts] == [("AAPL", 3, 2023), ("BRK_Q", 3, 2023), (None, None, None), (None, None, None)]
    dates = spark.createDataFrame([("2024-02-03T10:00", 1, 2024), (None, 1, 2024), ("", 2, 2024), (None, 3, 2024), (None, 4, 2024)],
                                  "d string, q int, y int")
    out = [r[0] for r in dates.select(C.fallback_event_date(F.col("d"), F.col("q"), F.col("y"))).collect()]
    assert out == ["2024-02-03", "2024-04-15", "2024-07-15", "2024-10-15", "2025-01-15"]
    assert spark.range(1).select(C.parsed_date(F.lit("31/12/2024"))).first()[0] is None


def test_filters(spark):
    df = spark.createDataFrame([("A", 2023, q, "x" * 200) for q in (1, 2, 3, 4)] + [(None, 2023, 1, "x" * 200), ("A", 2024, 1, " " * 300)],
                               "ticker string, year int, quarter int, transcript string")
    assert {r["reason"]: r["n"] for r in cleaning.reject_counts(df).collect()} == {"kept": 4, "null_key": 1, "empty": 1}
    kept = cleaning.clean_transcripts(df)
    assert [r["quarter"] for r in cleaning.last_quarters(kept, 2, D(2023, 12, 1)).orderBy("quarter").collect()] == [2, 3]
    assert cleaning.year_range(kept, "2023").count() == 4 and cleaning.year_range(kept, "2024-2025").count() == 0
    text = spark.createDataFrame([("a" * 30 + "b" * 50 + "c" * 20,)], "t string")
    cut = text.select(C.truncate_middle(F.col("t"), 90, 30, 20)).first()[0]
    assert cut.startswith("a" * 30 + "\n\n[") and cut.endswith("]\n\n" + "c" * 20)


def test_word_lists_on_a_paragraph(spark):
    text = ("We believe revenue could rise, and it might, subject to approval. We may hire. "
            "Operator: questions? We will raise prices by 3.5% to 1,200 units. We are committed to growth.")
    df = spark.createDataFrame([(1, text)], "id int, text string")
    t = X.normalised(F.col("text"))
    row = df.select(X.hits(t, LEXICONS["hedging"]).alias("h"), X.hits(t, LEXICONS["definitive"]).alias("d"),
                    X.balance(t, LEXICONS["hedging"], LEXICONS["definitive"]).alias("b"),
                    X.words(t).alias("w"), X.specificity(F.col("text")).alias("s"),
                    X.section_shift(F.col("text"), "Operator:", LEXICONS["hedging"]).alias("shift")).first()
    assert (row["h"], row["d"]) == (5, 2) and row["b"] == pytest.approx(5 / 7)
    assert row["s"] == pytest.approx(2 * 100 / row["w"]) and 0 < row["shift"] <= 1
    out = documents.lexicon_density(df, ["id"], "text", LEXICONS).where("lexicon = 'hedging'").first()
    assert out["hits"] == 5 and out["per_1000"] == pytest.approx(5000 / row["w"])
    assert spark.range(1).select(X.balance(X.normalised(F.lit("...")), ["a"], ["b"])).first()[0] == 0.5


def test_many_to_many_join_and_dedupe(spark):
    f = spark.createDataFrame([("a", "2024-01-05"), ("a", "2024-03-05"), ("b", "bad")], "ticker string, filingDate string")
    a = spark.createDataFrame([("A", 1, 2024, 0.5)], "symbol string, quarter int, year int, x double")
    keys = cleaning.filing_keys(f)
    assert joins.join_sources(keys, a).count() == 2
    assert joins.join_sources(keys, a, "latest").first()["filingDate"] == "2024-03-05"


def test_coverage_and_median_imputation(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, None, 9.0], "b": [None, None, None, 1.0]})
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in pdf])
    assert cleaning.covered_features(df, ["a", "b"]) == ["a"]
    assert sorted(r["a"] for r in cleaning.median_impute(df, ["a"]).collect()) == [1.0, 2.0, 2.0, 9.0]
