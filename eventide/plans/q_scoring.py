"""Queries over scoring, labels, trading rules, metrics, views and status."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from eventide.definitions import (ALPHA_CUTS, ALPHA_MARKET_BASELINE, ALPHA_MODEL, HORIZON_ORDER, KNOWN_FEATURES)
from eventide.functions import columns as C
from eventide.operators import alpha, cleaning, evaluation, joins, scoring, signals, views
from eventide.operators.ordering import distribution
from eventide.operators.scoring import ScoringModel
from eventide.plans.oracle_tables import sql
from eventide.plans.q_cleaning import META_SQL, TODAY, feature_meta
from eventide.plans.q_signals import (BEARISH, FEATS, FILING_FEATS, PVALUE, RANKED, RETS, ic_sql, long_sql, pairs_sql, rounded_sql,
                                      signal_table, staged, stats_sql, STAT_COLS)
from eventide.plans.registry import query
from eventide.session import stage
from eventide.sources import warehouse as wh

KEY = ["symbol", "quarter", "year"]
# Weights of a small hand-set model; scaler and thresholds come from the data.
WEIGHTS = {"mgmt_hedging": -1.5, "mgmt_deflection": 0.0, "analyst_skepticism": -0.75, "competitive_mentions": 0.5,
           "customer_language": 2.0, "pricing_power": 1.25}
INTERCEPT = 0.3
LIVE = [f for f, w in WEIGHTS.items() if w]


def model_data(spark, sf):
    """The columns the scoring queries look at, staged: the model fit and the scoring read them again."""
    return stage(wh.dataset(spark, sf).select(
        *KEY, "earnings_date", "return_5D", *[f"feat_{f}" for f in WEIGHTS]), "dataset")


def hand_model(data, cuts: bool = True) -> ScoringModel:
    rows = signals.scaler_fit(data, {f: f"feat_{f}" for f in WEIGHTS}).collect()  # one per feature
    model = ScoringModel(
        list(WEIGHTS), WEIGHTS, INTERCEPT, {r["feature"]: round(r["mean"], 6) for r in rows},
        {r["feature"]: round(r["std"], 6) for r in rows})
    if cuts:
        raw = data.select(scoring.raw_score(model).alias("score"))
        model.score_percentiles = scoring.score_distribution(raw).first().asDict()
    return model


def scored(spark, sf):
    data = model_data(spark, sf)
    return scoring.score_events(data, hand_model(data), [*KEY, "return_5D"])


PART = {f: f"((feat_{f} - m_{f}) / s_{f} * {w}e0)" for f, w in WEIGHTS.items()}
SCORED = {
    "sc": "select " + ", ".join(f"round(avg(feat_{f}), 6) as m_{f}, round(stddev_pop(feat_{f}), 6) as s_{f}" for f in LIVE) + " from dataset",
    "raw": f"select d.*, {INTERCEPT}e0 + " + " + ".join(f"coalesce({PART[f]}, 0)" for f in LIVE)
           + " as score, " + ", ".join(f"round({PART[f]}, 4) + 0 as c_{f}" for f in LIVE) + " from dataset d, sc",
    "cuts": "select " + ", ".join(f"quantile_cont(score, {q}) as {p}" for p, q in scoring.SCORE_QUANTILES.items())
            + ", avg(score) as mean, stddev_pop(score) as std from raw",
    "labeled": """select raw.*, round(score, 4) + 0 as raw_score, round(score, 2) + 0 as expected_return_pct,
      case when score >= p75 then 'LONG' when score <= p25 then 'SHORT' else 'NEUTRAL' end as signal,
      case when score >= p75 then case when score >= p90 then 'high' else 'medium' end
           when score <= p25 then case when score <= p10 then 'high' else 'medium' end else 'low' end as confidence,
      case when score >= p90 then '>90th' when score >= p75 then '75-90th' when score >= p50 then '50-75th'
           when score >= p25 then '25-50th' when score >= p10 then '10-25th' else '<10th' end as percentile
      from raw, cuts""",
}
LABELS = "raw_score, expected_return_pct, signal, confidence, percentile"


def scored_sql(select: str, **more: str) -> str:
    return sql(["dataset"], select, **SCORED, **more)


PARTS_SQL = " union all ".join(
    f"select symbol, quarter, year, '{f}' as feature, c_{f} as contribution, {i} as i from labeled where c_{f} is not null"
    for i, f in enumerate(LIVE))


@query("score_events", scored_sql(f"""
  select l.symbol, l.quarter, l.year, {LABELS}, p.feature, p.contribution, p.place from labeled l left join (
    select *, row_number() over (partition by symbol, quarter, year order by abs(contribution) desc, i) as place from parts) p
  using (symbol, quarter, year)""", parts=PARTS_SQL))
def q_score_events(spark, sf):
    out = scored(spark, sf)
    return out.select(*KEY, "raw_score", "expected_return_pct", "signal", "confidence", "percentile",
                      F.posexplode("feature_contributions").alias("p", "c")).select(
        *KEY, "raw_score", "expected_return_pct", "signal", "confidence", "percentile", "c.feature", "c.contribution",
        (F.col("p") + 1).alias("place"))


@query("label_signal", scored_sql("select symbol, quarter, year, signal, confidence, percentile from labeled"))
def q_label(spark, sf):
    return scored(spark, sf).select(*KEY, "signal", "confidence", "percentile")


@query("score_all", scored_sql(f"select symbol, quarter, year, {LABELS} from labeled order by raw_score desc"))
def q_score_all(spark, sf):
    return scored(spark, sf).drop("feature_contributions", "return_5D").orderBy(F.desc("raw_score"), *KEY)


@query("score_percentiles", scored_sql("select " + ", ".join(f"round({c}, 4) + 0 as {c}" for c in [*scoring.SCORE_QUANTILES, "mean", "std"]) + " from cuts"))
def q_score_percentiles(spark, sf):
    data = model_data(spark, sf)
    raw = data.select(scoring.raw_score(hand_model(data, cuts=False)).alias("score"))
    return signals.rounded(scoring.score_distribution(raw))


@query("signal_counts", scored_sql("""
  select 'signal' as kind, signal as value, count(*) as n from labeled group by signal
  union all select 'confidence', confidence, count(*) from labeled group by confidence
  union all select 'total', 'all', count(*) from labeled"""))
def q_signal_counts(spark, sf):
    return scoring.signal_counts(scored(spark, sf))


@query("rank_scores", scored_sql("select symbol, quarter, year, raw_score, row_number() over (order by raw_score desc, symbol, quarter, year) as place from labeled"))
def q_rank_scores(spark, sf):
    return scoring.rank_scores(scored(spark, sf).select(*KEY, "raw_score"), KEY)


TOP = "place, symbol, quarter, year, raw_score, signal"


@query("top_longs", scored_sql(f"select {TOP} from (select *, row_number() over (order by raw_score desc, symbol, quarter, year) as place from labeled) x where place <= 20"))
def q_top_longs(spark, sf):
    return scoring.top_k(scored(spark, sf), 20, KEY).select(*TOP.split(", "))


@query("top_shorts", scored_sql(f"select {TOP} from (select *, row_number() over (order by raw_score, symbol desc, quarter desc, year desc) as place from labeled) x where place <= 20"))
def q_top_shorts(spark, sf):
    return scoring.top_k(scored(spark, sf), 20, KEY, lowest=True).select(*TOP.split(", "))


@query("top_driver", scored_sql("""
  select symbol, quarter, year, feature || ' (' || case when contribution > 0 then '+' else '' end || printf('%.4f', contribution) || ')' as driver
  from (select *, row_number() over (partition by symbol, quarter, year order by abs(contribution) desc, i) as place from parts) p where place = 1""", parts=PARTS_SQL))
def q_top_driver(spark, sf):
    return scored(spark, sf).select(*KEY, scoring.top_driver().alias("driver"))


@query("list_scores", scored_sql("""
  select symbol, quarter, year, raw_score, signal, confidence from labeled where signal = 'LONG' and confidence = 'high'
  order by raw_score desc, symbol, quarter, year limit 50 offset 10"""))
def q_list_scores(spark, sf):
    page = scoring.scores_matching(scored(spark, sf), "long", "HIGH")
    return scoring.scores_page(page, KEY, 50, 10).select(*KEY, "raw_score", "signal", "confidence")


@query("list_scores_summary", scored_sql("""
  select 'matching' as kind, 'all' as value, count(*) as n from labeled where signal = 'LONG' and confidence = 'high'
  union all select 'signal', signal, count(*) from labeled group by signal union all select 'confidence', confidence, count(*) from labeled group by confidence
  union all select 'total', 'all', count(*) from labeled"""))
def q_list_summary(spark, sf):
    out = scored(spark, sf)
    matching = scoring.scores_matching(out, "LONG", "high").agg(F.count(F.lit(1)).alias("n"))
    return scoring.signal_counts(out).unionByName(matching.select(F.lit("matching").alias("kind"), F.lit("all").alias("value"), "n"))


# --- predictions against outcomes ------------------------------------------------------------------

PREDICTIONS_SQL = "select symbol, quarter, year, earnings_date, 'hand' as model, score as predicted, return_5D as actual from raw"


def predictions(spark, sf):
    data = model_data(spark, sf)
    score = scoring.raw_score(hand_model(data, cuts=False))
    return data.select(*KEY, "earnings_date", F.lit("hand").alias("model"),
                                        score.alias("predicted"), F.col("return_5D").alias("actual"))


@query("regression_metrics", scored_sql("""
  select model, count(*) as n, round(1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)), 4) as r2,
    round(sqrt(avg((actual - predicted) ** 2)), 4) as rmse, round(avg(abs(actual - predicted)), 4) as mae,
    round(avg(case when (predicted > 0) = (actual > 0) then 1e0 else 0e0 end), 4) as dir_acc from preds group by model""", preds=PREDICTIONS_SQL))
def q_metrics(spark, sf):
    return signals.rounded(evaluation.regression_metrics(predictions(spark, sf), ["model"]).drop("sharpe"))


@query("strategy_sharpe", scored_sql("""
  select model, round(avg(s) / stddev_pop(s) * sqrt(252 / 5e0), 4) as sharpe from (
    select model, case when predicted > 0 then actual else -actual end as s from preds) x group by model""", preds=PREDICTIONS_SQL))
def q_strategy(spark, sf):
    return signals.rounded(evaluation.regression_metrics(predictions(spark, sf), ["model"]).select("model", "sharpe"))


@query("cumulative_strategy", scored_sql("""
  select model, symbol, quarter, year, round(strategy, 4) + 0 as strategy, round(sum(strategy) over (order by earnings_date, symbol rows unbounded preceding), 4) + 0 as cumulative
  from (select *, case when predicted > 0 then actual else -actual end as strategy from preds) x""", preds=PREDICTIONS_SQL))
def q_cumulative(spark, sf):
    out = evaluation.cumulative_strategy(predictions(spark, sf), ["earnings_date", "symbol"])
    return out.select("model", *KEY, (F.round("strategy", 4) + 0.0).alias("strategy"), (F.round("cumulative", 4) + 0.0).alias("cumulative"))


# --- weights and model tables, from one-feature fits that SQL can state ------------------------------

UNIVARIATE = """
  select horizon, feature, round(regr_slope(ret, score), 3) + 0 as ridge,
    round(case when abs(corr(ret, score)) > 0.02 then regr_slope(ret, score) * 0.9 else 0 end, 3) + 0 as lasso,
    round(pow(corr(ret, score), 2), 6) as cv_r2 from pairs group by horizon, feature"""
BLENDED = """
  select horizon, feature, round(b, 4) as weight from (
    select horizon, feature, case when lasso = 0 then ridge * 0.2e0 else (ridge + lasso) / 2 end as b from uni) x where abs(b) > 0.001"""


def univariate(spark, sf):
    """One-feature fits per horizon: slope, a thresholded slope and the squared correlation."""
    long = wh.dataset(spark, sf).select(
        *[F.col(c).alias(f) for f, c in FEATS.items()], *[F.col(c).alias(h) for h, c in RETS.items()])
    by_feature = long.unpivot(list(RETS), list(FEATS), "feature", "score")
    pairs = by_feature.unpivot(["feature", "score"], list(RETS), "horizon", "ret").where("score is not null and ret is not null")
    fits = pairs.groupBy("horizon", "feature").agg(F.regr_slope("ret", "score").alias("slope"), F.corr("ret", "score").alias("r"))
    return fits.select(
        "horizon", "feature", (F.round("slope", 3) + 0.0).alias("ridge"),
        (F.round(F.when(F.abs("r") > 0.02, F.col("slope") * 0.9).otherwise(0.0), 3) + 0.0).alias("lasso"),
        F.round(F.col("r") * F.col("r"), 6).alias("cv_r2"))


UNI = {"pairs": pairs_sql("dataset", FEATS, RETS), "uni": UNIVARIATE}


@query("blend_weights", sql(["dataset"], "select horizon, feature, weight from blended", **UNI, blended=BLENDED))
def q_blend(spark, sf):
    return evaluation.blend_weights(univariate(spark, sf)).select("horizon", "feature", "weight")


@query("top_weights", sql(["dataset"], """
  select horizon, feature, weight, place from (select *, row_number() over (partition by horizon order by abs(weight) desc, feature) as place from blended) x
  where place <= 5""", **UNI, blended=BLENDED))
def q_top_weights(spark, sf):
    return evaluation.top_weights(evaluation.blend_weights(univariate(spark, sf)).select("horizon", "feature", "weight"), 5)


COMPARED = "select horizon, feature as model, cv_r2, row_number() over (partition by horizon order by cv_r2 desc, feature) as place from uni"


def compared(spark, sf):
    return evaluation.model_comparison(univariate(spark, sf).select("horizon", F.col("feature").alias("model"), "cv_r2"))


@query("rank_models", sql(["dataset"], COMPARED, **UNI))
def q_rank_models(spark, sf):
    return compared(spark, sf)


@query("best_horizon", sql(["dataset"], "select horizon, cv_r2 from uni order by cv_r2 desc, list_position(['1D', '5D', '10D', '21D'], horizon) limit 1", **UNI))
def q_best_horizon(spark, sf):
    return evaluation.best_horizon(compared(spark, sf))


TARGETS_SQL = " union all ".join(
    f"select '{h}' as horizon, count({c}) as n, avg({c}) as y_mean, stddev_pop({c}) as y_std, median({c}) as y_median from dataset" for h, c in RETS.items())


def targets(spark, sf):
    long = wh.dataset(spark, sf).select(*[F.col(c).alias(h) for h, c in RETS.items()]).unpivot([], list(RETS), "horizon", "y").where("y is not null")
    out = distribution(long, ["horizon"], "y", {"y_median": 0.5}, "targets")
    return out.select("horizon", "n", F.col("mean").alias("y_mean"), F.col("std").alias("y_std"), "y_median")


@query("target_summary", sql(["dataset"], "select horizon, n, round(y_mean, 4) as y_mean, round(y_std, 4) as y_std, round(y_median, 6) as y_median from targets", targets=TARGETS_SQL))
def q_targets(spark, sf):
    t = targets(spark, sf)
    return t.select("horizon", "n", F.round("y_mean", 4).alias("y_mean"), F.round("y_std", 4).alias("y_std"), F.round("y_median", 6).alias("y_median"))


@query("view_predictions", sql(["dataset"], f"""
  select t.horizon, c.model as best_model, c.cv_r2 as best_cv_r2, t.n, round(t.y_mean, 4) as intercept, w.feature, w.weight, w.place
  from targets t join ({COMPARED}) c on c.horizon = t.horizon and c.place = 1
  join (select *, row_number() over (partition by horizon order by abs(weight) desc, feature) as place from blended) w on w.horizon = t.horizon""",
    **UNI, blended=BLENDED, targets=TARGETS_SQL))
def q_view_predictions(spark, sf):
    t = targets(spark, sf).select("horizon", "n", F.round("y_mean", 4).alias("intercept"))
    fits = stage(univariate(spark, sf), "fits")
    ranked = evaluation.model_comparison(fits.select("horizon", F.col("feature").alias("model"), "cv_r2"))
    view = views.view_predictions(evaluation.blend_weights(fits), ranked, t)
    return view.select("horizon", "best_model", "best_cv_r2", "n", "intercept", F.posexplode("weights").alias("p", "w")).select(
        "horizon", "best_model", "best_cv_r2", "n", "intercept", "w.feature", "w.weight", (F.col("p") + 1).alias("place"))


@query("view_features", sql(["dataset"], f"select feature, horizon, {rounded_sql(STAT_COLS + ' ic ic_pvalue')}, n_observations, n_signal_triggered from stats join pv using (feature, horizon)",
       pairs=pairs_sql("dataset", FEATS, RETS), ranked=RANKED, ic=ic_sql(20), pv=PVALUE, stats=stats_sql(BEARISH)))
def q_view_features(spark, sf):
    return views.view_features(signal_table(spark, sf))


@query("view_feature_cards", sql(["dataset"], """
  select m.feature, m.name, m.category, m.bear, x.max_abs_ic, row_number() over (order by x.max_abs_ic desc nulls last, m.feature) as place
  from meta m left join (select feature, max(abs(round(ic, 4))) as max_abs_ic from ic group by feature) x using (feature) where m.category = 'Management Behavior'""",
    meta=META_SQL, pairs=pairs_sql("dataset", FEATS, RETS), ranked=RANKED, ic=ic_sql(20)))
def q_cards(spark, sf):
    ic = signals.rounded(signals.feature_ic(staged(spark, sf), FEATS, RETS))
    return views.view_feature_cards(feature_meta(spark), ic, "Management Behavior")


# --- metadata and status --------------------------------------------------------------------------------


@query("dataset_metadata", sql(["dataset"], "select count(*) as total_events, list_sort(list(distinct symbol)) as companies, min(earnings_date) as first_date, max(earnings_date) as last_date from dataset"))
def q_metadata(spark, sf):
    return views.dataset_metadata(wh.dataset(spark, sf), "symbol", "earnings_date")


@query("dataset_symbols", sql(["dataset"], "select symbol, count(*) as total_events, min(earnings_date) as first_date, max(earnings_date) as last_date from dataset group by symbol"))
def q_symbols(spark, sf):
    """The companies of the dataset, as rows."""
    return views.dataset_symbols(wh.dataset(spark, sf), "symbol", "earnings_date")


INCOMPLETE = " or ".join(f"return_{h} is null" for h in HORIZON_ORDER)


@query("status_counts", sql(["transcripts", "returns_short"], f"""
  select 'transcripts' as item, count(*) as n from transcripts union all select 'companies', count(distinct ticker) from transcripts
  union all select 'analyses', count(*) from labels
  union all select 'pending', count(*) from transcripts where doc_id not in (select doc_id from labels)
  union all select 'price_rows', count(*) from returns_short
  union all select 'incomplete', count(*) from returns_short where {INCOMPLETE}
  union all select 'recent', count(*) from returns_short where date '2001-06-01' - event_date < 35
  union all select 'missing', count(*) from ev where (symbol, quarter, year) not in (select (symbol, quarter, year) from returns_short)"""))
def q_status(spark, sf):
    t = wh.transcripts(spark, sf)
    labels = wh.read(spark, sf, "labels")
    cache = wh.price_cache(spark, sf, 30)
    one = lambda df, item, col: df.agg(col.cast("bigint").alias("n")).select(F.lit(item).alias("item"), "n")
    prices = cache.agg(
        F.count(F.lit(1)).alias("price_rows"), F.count_if(F.expr(INCOMPLETE)).alias("incomplete"),
        F.count_if(F.datediff(F.lit(TODAY), "event_date") < 35).alias("recent")).unpivot([], ["price_rows", "incomplete", "recent"], "item", "n")
    docs = t.agg(F.count(F.lit(1)).alias("transcripts"), F.count_distinct("ticker").alias("companies")).unpivot(
        [], ["transcripts", "companies"], "item", "n")
    return (docs.unionByName(one(labels, "analyses", F.count(F.lit(1))))
            .unionByName(one(joins.pending(t.select("doc_id"), labels, ["doc_id"]), "pending", F.count(F.lit(1))))
            .unionByName(prices)
            .unionByName(one(joins.pending(wh.events(spark, sf), cache, KEY), "missing", F.count(F.lit(1)))))


@query("source_inventory", sql(["dataset", "filings"], """
  select 'earnings' as source, count(*) as total_events, count(distinct symbol) as companies, max(earnings_date) as last_date, count(*) > 0 as available from dataset
  union all select 'filings', count(*), count(distinct ticker), max(filingDate), count(*) > 0 from filings"""))
def q_inventory(spark, sf):
    return views.source_inventory({
        "earnings": wh.dataset(spark, sf).select("symbol", F.col("earnings_date").alias("date")),
        "filings": wh.filings(spark, sf).select(F.col("ticker").alias("symbol"), F.col("filingDate").alias("date"))})


_NLP_ROWS = ", ".join(f"('nlp_{f}', cast({f} as double))" for f in KNOWN_FEATURES)
_SEC_ROWS = ", ".join(f"('sec_{snake}', cast({raw} as double))" for snake, raw in FILING_FEATS.items())


@query("union_rows", sql(["scores", "filings"], f"""
  select symbol, quarter, year, x[1] as family, x[2] as value from (select symbol, quarter, year, unnest([{_NLP_ROWS}]) as x from scores) a
  union all select symbol, quarter, year, x[1], x[2] from (
    select upper(ticker) as symbol, quarter(cast(filingDate as date)) as quarter, year(cast(filingDate as date)) as year, unnest([{_SEC_ROWS}]) as x from filings) b"""))
def q_union(spark, sf):
    """Both feature families in one long table, a row per event and feature."""
    long = lambda df, prefix, columns: df.select(*KEY, F.explode(F.array(*[
        F.struct(F.lit(prefix + name).alias("family"), F.col(c).cast("double").alias("value")) for name, c in columns.items()])).alias("x")).select(*KEY, "x.*")
    nlp = long(wh.feature_scores(spark, sf), "nlp_", {f: f for f in KNOWN_FEATURES})
    return nlp.unionByName(long(cleaning.filing_keys(wh.filings(spark, sf)), "sec_", FILING_FEATS))


# --- alpha model ---------------------------------------------------------------------------------------------

SNAPSHOT = {
    "ticker": "ticker", "filing_date": "filingDate", "current_price": "currentPrice",
    "low_52w": "case when analystCoverage % 8 = 0 then 0e0 else fiftyTwoWeekLow * 20 end",
    "high_52w": "fiftyTwoWeekHigh", "market_cap": "marketCap",
    "target_price": "case when analystCoverage % 3 <> 0 then currentPrice * 1.2e0 end",
    "concern_level": "case when analystCoverage % 5 <> 0 then concernLevel end", "sentiment_score": "sentimentScore",
    "upgrades_last_30d": "upgradesLast30d / 8", "major_downgrades": "majorDowngrades",
    "actual_alpha": "actual30dAlpha",
}
ALPHA_INPUT = {
    "price_to_low": "coalesce(case when low_52w > 0 then current_price / low_52w end, 1.3978e0)",
    "price_to_high": "coalesce(case when high_52w > 0 then current_price / high_52w end, 0.8588e0)",
    "analyst_upside_potential": "coalesce((target_price / current_price - 1) * 100, 13.518e0)",
    "concern_level": "coalesce(concern_level, 5.345e0)", "sentiment_score": "coalesce(sentiment_score, 0.0236e0)",
    "market_cap": "market_cap", "upgrades_last_30d": "upgrades_last_30d", "major_downgrades": "major_downgrades",
}
_A = "".join(f" + {w!r}e0 * (({f} - {m!r}e0) / {s!r}e0)" for f, (w, m, s) in ALPHA_MODEL.items())


def _alpha_label(a, b, c, d, e):
    return (f"case when s > {ALPHA_CUTS['p90']}e0 then {a} when s > {ALPHA_CUTS['p75']}e0 then {b} when s < {ALPHA_CUTS['p10']}e0 then {c} "
            f"when s < {ALPHA_CUTS['p25']}e0 then {d} else {e} end")


ALPHA_SQL = {
    "snapshot": "select " + ", ".join(f"{e} as {c}" for c, e in SNAPSHOT.items()) + " from filings",
    "inputs": "select ticker, filing_date, actual_alpha, " + ", ".join(f"{e} as {f}" for f, e in ALPHA_INPUT.items()) + " from snapshot",
    "alpha": f"""select *, round(s, 4) + 0 as raw_score, {_alpha_label("'LONG'", "'LONG'", "'SHORT'", "'SHORT'", "'NEUTRAL'")} as signal,
      {_alpha_label("'high'", "'medium'", "'high'", "'medium'", "'low'")} as confidence,
      {_alpha_label("'>90th'", "'75th-90th'", "'<10th'", "'10th-25th'", "'25th-75th'")} as percentile,
      round(s + {ALPHA_MARKET_BASELINE}e0, 2) + 0 as predicted_30d_return from (select *, 0e0{_A} as s from inputs) x""",
}


def snapshot(spark, sf):
    return wh.filings(spark, sf).select(*[F.expr(e).alias(c) for c, e in SNAPSHOT.items()])


def alpha_scored(spark, sf):
    return alpha.alpha_score(alpha.alpha_features(snapshot(spark, sf)))


@query("alpha_features", sql(["filings"], "select ticker, filing_date, " + ", ".join(f"round({f}, 8) as {f}" for f in ALPHA_INPUT) + " from inputs", **ALPHA_SQL))
def q_alpha_features(spark, sf):
    return signals.rounded(alpha.alpha_features(snapshot(spark, sf)).select("ticker", "filing_date", *ALPHA_INPUT), 8)


@query("alpha_score", sql(["filings"], """
  select ticker, filing_date, raw_score, round(s, 2) + 0 as expected_alpha, signal, confidence, percentile, predicted_30d_return,
    round(predicted_30d_return * (7 / 30e0), 6) + 0 as predicted_7d_return, case confidence when 'high' then 0.85e0 when 'medium' then 0.65e0 else 0.5e0 end as prediction_confidence
  from alpha""", **ALPHA_SQL))
def q_alpha_score(spark, sf):
    return alpha_scored(spark, sf).select(
        "ticker", "filing_date", "raw_score", "expected_alpha", "signal", "confidence", "percentile", "predicted_30d_return",
        (F.round("predicted_7d_return", 6) + 0.0).alias("predicted_7d_return"), "prediction_confidence")


@query("accuracy_report", sql(["filings"], """
  select count(*) as total_predictions, count(actual_alpha) as predictions_with_actuals, round(avg(case when judged then hit end), 4) as directional_accuracy,
    round(avg(case when judged and confidence = 'high' then hit end), 4) as high_conf_directional_accuracy,
    round(avg(case when signal = 'LONG' then actual_alpha end), 4) as avg_long_alpha, round(avg(case when signal = 'SHORT' then actual_alpha end), 4) as avg_short_alpha,
    round(avg(case when signal = 'LONG' then actual_alpha end) - avg(case when signal = 'SHORT' then actual_alpha end), 4) as long_short_spread
  from (select *, signal <> 'NEUTRAL' and actual_alpha is not null as judged,
        case when (signal = 'LONG' and actual_alpha > 0) or (signal = 'SHORT' and actual_alpha < 0) then 1e0 else 0e0 end as hit from alpha) x""", **ALPHA_SQL))
def q_accuracy(spark, sf):
    return signals.rounded(alpha.accuracy_report(alpha_scored(spark, sf)))


TEXTS_SQL = """case when signal = 'LONG' and confidence = 'high' then 'Strong Buy — model expects significant outperformance'
  when signal = 'LONG' then 'Buy — model expects moderate outperformance'
  when signal = 'SHORT' and confidence = 'high' then 'Strong Sell — model expects significant underperformance'
  when signal = 'SHORT' then 'Sell — model expects moderate underperformance' else 'Hold — no clear signal' end"""


@query("trade_rules", sql(["filings"], f"""
  select ticker, filing_date, case signal when 'LONG' then 'BUY' when 'SHORT' then 'SELL' else 'HOLD' end as action,
    case confidence when 'high' then 1e0 when 'medium' then 0.5e0 else 0e0 end as size, case confidence when 'high' then 8e0 when 'medium' then 5e0 end as target_pct,
    case confidence when 'high' then -5e0 when 'medium' then -3e0 end as stop_pct, case when confidence <> 'low' then 30 end as hold_days, {TEXTS_SQL} as recommendation
  from alpha""", **ALPHA_SQL))
def q_trade(spark, sf):
    return alpha.trade_rules(alpha_scored(spark, sf)).select(
        "ticker", "filing_date", "action", "size", "target_pct", "stop_pct", "hold_days",
        C.recommendation(F.col("signal"), F.col("confidence")).alias("recommendation"))


@query("trade_rules_legacy", sql(["filings"], """
  select ticker, filing_date, case when confidence <> 'low' and predicted_30d_return >= 2 then 'BUY' when confidence <> 'low' and predicted_30d_return <= -2 then 'SELL' else 'HOLD' end as action
  from alpha""", **ALPHA_SQL))
def q_trade_legacy(spark, sf):
    df = alpha_scored(spark, sf).withColumn("predicted_return", F.col("predicted_30d_return"))
    return alpha.trade_rules_legacy(df).select("ticker", "filing_date", "action")


@query("coverage_audit", sql(["filings", "actions"], """
  select 'actions' as item, 'all' as value, count(*) as n from actions union all select 'firms', 'distinct', count(distinct firm) from actions
  union all select 'action_type', action_type, count(*) from actions group by action_type
  union all select 'predictions', 'missing alpha', count(case when sentimentScore is not null and actual30dAlpha is null then 1 end) from filings
  union all select 'target_price', 'usable', count(case when priceToTarget > 0 then 1 end) from filings"""))
def q_audit(spark, sf):
    acts, fil = wh.actions(spark, sf), wh.filings(spark, sf)
    by_type = acts.groupBy(F.lit("action_type").alias("item"), F.col("action_type").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    totals = acts.agg(F.count(F.lit(1)).alias("all"), F.count_distinct("firm").alias("distinct")).unpivot([], ["all", "distinct"], "value", "n").select(
        F.when(F.col("value") == "all", "actions").otherwise("firms").alias("item"), "value", "n")
    audit = fil.agg(
        F.count_if(F.col("sentimentScore").isNotNull() & F.col("actual30dAlpha").isNull()).alias("missing alpha"),
        F.count_if(F.col("priceToTarget") > 0).alias("usable")).unpivot([], ["missing alpha", "usable"], "value", "n").select(
        F.when(F.col("value") == "usable", "target_price").otherwise("predictions").alias("item"), "value", "n")
    return totals.unionByName(by_type).unionByName(audit)
