"""Queries over sources' rows: filters, cleaning, parsing, keys and joins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from eventide.definitions import (BEARISH, FILING_RENAME, HORIZON_ORDER, KNOWN_FEATURES, TRANSCRIPT_FEATURES)
from eventide.functions import columns as C
from eventide.operators import cleaning, joins, signals, technical
from eventide.operators.returns import forward_returns, price_window
from eventide.plans.oracle_tables import sql
from eventide.plans.q_signals import FEATS, RANKED, RETS, ic_sql, long_sql, pairs_sql, staged
from eventide.plans.registry import query
from eventide.session import stage
from eventide.sources import warehouse as wh

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
CLEAN = f"length({STRIP.format('transcript')}) >= 100"
KEY = ["symbol", "quarter", "year"]
TKEY = ["ticker", "quarter", "year"]


@query("clean_transcripts", sql(["transcripts"], f"select doc_id, ticker, quarter, year, length(transcript) as n_chars from transcripts where {CLEAN}"))
def q_clean(spark, sf):
    return cleaning.clean_transcripts(wh.transcripts(spark, sf)).select(
        "doc_id", *TKEY, F.length("transcript").cast("bigint").alias("n_chars"))


@query("clean_transcripts_rejects", sql(["transcripts"], f"select case when {CLEAN} then 'kept' else 'empty' end as reason, count(*) as n from transcripts group by 1"))
def q_rejects(spark, sf):
    return cleaning.reject_counts(wh.transcripts(spark, sf))


@query("filter_last_n_quarters", sql(["transcripts"], "select doc_id, quarter, year from transcripts where year * 4 + quarter between 2024 * 4 + 2 - 8 and 2024 * 4 + 2 - 1"))
def q_last_quarters(spark, sf):
    return cleaning.last_quarters(wh.transcripts(spark, sf), 8, dt.date(2024, 5, 20)).select("doc_id", "quarter", "year")


@query("filter_year_range", sql(["transcripts"], "select doc_id, year from transcripts where year >= 2016 and year <= 2018"))
def q_year_range(spark, sf):
    return cleaning.year_range(wh.transcripts(spark, sf), "2016-2018").select("doc_id", "year")


@query("filter_analyzable", sql(["transcripts"], "select doc_id, length(transcript) as n_chars from transcripts where length(transcript) >= 500"))
def q_analyzable(spark, sf):
    return cleaning.analyzable(wh.transcripts(spark, sf)).select("doc_id", F.length("transcript").cast("bigint").alias("n_chars"))


def truncated(limit: int, head: int, tail: int) -> str:
    return (f"case when length(transcript) > {limit} then left(transcript, {head}) || chr(10) || chr(10) || "
            f"'[... middle section truncated ...]' || chr(10) || chr(10) || right(transcript, {tail}) else transcript end")


# a lower limit than the requests have, so that texts of the given tables are cut at all
TRUNCATED = truncated(8000, 3000, 5000)


@query("truncate_middle", sql(["transcripts"], f"select doc_id, length({TRUNCATED}) as n_chars, md5({TRUNCATED}) as digest from transcripts"))
def q_truncate(spark, sf):
    text = C.truncate_middle(F.col("transcript"), 8000, 3000, 5000)
    return wh.transcripts(spark, sf).select("doc_id", F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("digest"))


INSTRUCTIONS = "Score each feature from 0 to 1 and answer with JSON only."


@query("build_requests", sql(["transcripts"], f"""
  select doc_id, ticker || '_Q' || quarter || '_' || year as custom_id,
    md5('Transcript of ' || ticker || ', quarter ' || quarter || ' of ' || year || ':' || chr(10) || chr(10)
        || {truncated(80000, 30000, 50000)} || chr(10) || chr(10) || '{INSTRUCTIONS}') as digest,
    cast((row_number() over (order by ticker, year, quarter, doc_id) - 1) // 100 + 1 as bigint) as batch_no
  from transcripts where length(transcript) >= 500"""))
def q_build_requests(spark, sf):
    work = cleaning.analyzable(wh.transcripts(spark, sf))
    out = cleaning.build_requests(work, INSTRUCTIONS, ["ticker", "year", "quarter", "doc_id"], 100)
    return out.select("doc_id", "custom_id", F.md5("prompt").alias("digest"), "batch_no")


# Raw responses as they come back: plain, fenced with a language tag, closing fence only, cut off.
_SCORE = "coalesce(cast({} as string), 'null')"
_BODY = ("'{{\"features\": {{\"mgmt_hedging\": {{\"score\": ' || {a} || ', \"evidence\": \"n ' || n || '\", \"section\": \"qa\"}}, "
         "\"mgmt_deflection\": 0.5, \"analyst_surprise\": {{\"score\": ' || {b} || ', \"evidence\": \"\", \"section\": \"both\"}}, "
         "\"made_up\": {{\"score\": 1.0, \"evidence\": \"\", \"section\": \"qa\"}}}}, \"most_notable_signal\": \"s' || year || '\"}}'"
         ).format(a=_SCORE.format("mgmt_hedging"), b=_SCORE.format("analyst_surprise"))
_TEXT = ("case n % 4 when 0 then {b} when 1 then '```json' || chr(10) || {b} || chr(10) || '```' "
         "when 2 then '  ' || {b} || '```  ' else left({b}, 60) end").format(b=_BODY)


def responses(spark, sf):
    cid = C.custom_id(F.col("symbol"), F.col("quarter"), F.col("year"))
    return wh.feature_scores(spark, sf).select(cid.alias("custom_id"), F.expr(_TEXT).alias("text"))


@query("parse_response", sql(["scores"], """
  select custom_id, valid, case when valid then cast(json_extract(body, '$.features.mgmt_hedging.score') as double) end as hedging,
    case when valid then cast(json_extract(body, '$.features.analyst_surprise.score') as double) end as surprise,
    case when valid then json_extract_string(body, '$.features.mgmt_hedging.evidence') end as evidence,
    case when valid then 3 end as n_objects,
    case when valid then json_extract_string(body, '$.most_notable_signal') end as most_notable_signal
  from (select custom_id, json_valid(body) as valid, body from bodies) z""",
    raw=f"select symbol || '_Q' || quarter || '_' || year as custom_id, {_TEXT.replace('as string', 'as varchar')} as text from scores",
    bodies=r"""select custom_id, trim(regexp_replace(regexp_replace(trim(text), '^```[^\n]*\n', ''), '```$', ''), ' ' || chr(10)) as body from raw"""))
def q_parse_response(spark, sf):
    parsed = cleaning.parse_responses(responses(spark, sf))
    get = lambda f, part: F.try_element_at("features", F.lit(f))[part]
    return parsed.select(
        "custom_id", "valid", get("mgmt_hedging", "score").alias("hedging"),
        get("analyst_surprise", "score").alias("surprise"), get("mgmt_hedging", "evidence").alias("evidence"),
        F.when(F.col("valid"), F.size("features")).alias("n_objects"), "most_notable_signal")


_CID = ("case n % 4 when 0 then symbol || '_Q' || quarter || '_' || year when 1 then symbol || '_Q_Q' || quarter || '_' || year "
        "when 2 then symbol || '_' || quarter || '_' || year else symbol || '_Q' || quarter end")


@query("parse_custom_id", sql(["scores"], f"""
  select {_CID} as custom_id, case n % 4 when 0 then symbol when 1 then symbol || '_Q' end as symbol,
    case when n % 4 < 2 then quarter end as quarter, case when n % 4 < 2 then year end as year from scores"""))
def q_parse_custom_id(spark, sf):
    return wh.feature_scores(spark, sf).select(F.expr(_CID).alias("custom_id")).select(
        "custom_id", *C.custom_id_parts(F.col("custom_id")))


@query("explode_features", sql(["scores"], """
  select symbol, quarter, year, feature, score, feature || ' over ' || n || ' lines' as evidence,
    case n % 3 when 0 then 'prepared' when 1 then 'qa' else 'both' end as section from long
  union all select symbol, quarter, year, 'invented_extra', 0.5e0, 'x', 'qa' from scores""",
    long=long_sql("scores", {f: f for f in KNOWN_FEATURES}, "symbol, quarter, year, n")))
def q_explode_features(spark, sf):
    return cleaning.explode_features(wh.analysis(spark, sf), KEY)


@query("project_known_features", sql(["scores"], "select symbol, quarter, year, "
       + ", ".join(f"{f} as feat_{f}" for f in KNOWN_FEATURES) + " from scores"))
def q_project_known(spark, sf):
    return cleaning.known_features(wh.analysis(spark, sf), KEY)


@query("rename_columns", sql(["filings"], "select ticker, filingDate, "
       + ", ".join(f"{raw} as sec_{snake}" for raw, snake in FILING_RENAME.items())
       + ", actual7dReturn, actual30dReturn, actual7dAlpha, actual30dAlpha from filings"))
def q_rename(spark, sf):
    return wh.filings(spark, sf).withColumnsRenamed({r: f"sec_{s}" for r, s in FILING_RENAME.items()})


@query("resolve_column", sql(["filings"], "select ticker as symbol, filingDate as date from filings"))
def q_resolve(spark, sf):
    df = wh.filings(spark, sf)
    return df.select(F.col(cleaning.resolve_column(df, ["symbol", "Ticker", "ticker"])).alias("symbol"),
                     F.col(cleaning.resolve_column(df, ["date", "filing_date", "filingDate"])).alias("date"))


@query("derive_quarter", sql(["filings"], """
  select upper(ticker) as symbol, cast(quarter(d) as integer) as quarter, cast(year(d) as integer) as year, d as filed_on
  from (select ticker, try_cast(case when analystCoverage % 9 = 0 then 'n/a' else filingDate end as date) as d from filings) x"""))
def q_derive_quarter(spark, sf):
    text = F.when(F.col("analystCoverage") % 9 == 0, "n/a").otherwise(F.col("filingDate"))
    return cleaning.filing_keys(wh.filings(spark, sf).select("ticker", text.alias("filingDate"))).select(*KEY, "filed_on")


FALLBACK = """coalesce(left(earnings_date, 10), cast(make_date(cast(case when quarter = 4 then year + 1 else year end as integer),
    cast(case quarter when 1 then 4 when 2 then 7 when 3 then 10 else 1 end as integer), 15) as varchar))"""


@query("fallback_event_date", sql(["transcripts"], f"select doc_id, {FALLBACK} as event_date from transcripts"))
def q_fallback(spark, sf):
    return wh.transcripts(spark, sf).select(
        "doc_id", C.fallback_event_date(F.col("earnings_date"), F.col("quarter"), F.col("year")).alias("event_date"))


@query("reconstruct_sort_date", sql(["transcripts"], "select doc_id, make_date(year, cast(quarter * 3 as integer), 15) as sort_date from transcripts"))
def q_reconstruct(spark, sf):
    return wh.transcripts(spark, sf).select("doc_id", C.reconstructed_date(F.col("quarter"), F.col("year")).alias("sort_date"))


RAW = list(FILING_RENAME)


@query("coverage_filter", sql(["filings"], "select feature, round(c, 4) as coverage from ("
       + " union all ".join(f"select '{c}' as feature, count({c}) / (1e0 * count(*)) as c from filings where actual30dAlpha is not null" for c in RAW)
       + ") x where c > 0.5"))
def q_coverage(spark, sf):
    cov = cleaning.coverage(wh.filings(spark, sf).where("actual30dAlpha is not null"), RAW)
    return signals.rounded(cov.where("coverage > 0.5"))


IMPUTED = ["peRatio", "forwardPE", "priceToMA30", "rsi14"]


@query("median_impute", sql(["filings"], "select ticker, filingDate, "
       + ", ".join(f"round(coalesce({c}, median({c}) over ()), 10) as {c}" for c in IMPUTED) + " from filings where actual30dAlpha is not null"))
def q_impute(spark, sf):
    df = stage(wh.filings(spark, sf).where("actual30dAlpha is not null").select("ticker", "filingDate", *IMPUTED), "filings")
    return signals.rounded(cleaning.median_impute(df, IMPUTED), 10)


@query("drop_pairs", sql(["dataset"], "select symbol, quarter, year, feat_competitive_mentions, return_21D from dataset where feat_competitive_mentions is not null and return_21D is not null"))
def q_drop_pairs(spark, sf):
    cols = ["feat_competitive_mentions", "return_21D"]
    return wh.dataset(spark, sf).select(*KEY, *cols).dropna(subset=cols)


@query("drop_rows", sql(["dataset"], "select symbol, quarter, year, return_5D from dataset where return_5D is not null and "
       + " and ".join(f"feat_{f} is not null" for f in KNOWN_FEATURES)))
def q_drop_rows(spark, sf):
    return wh.dataset(spark, sf).dropna(subset=[*FEATS.values(), "return_5D"]).select(*KEY, "return_5D")


@query("sanitize_nan", sql(["dataset"], "select symbol, quarter, year, case when n % 10 > 2 then return_5D end as value from dataset"))
def q_sanitize(spark, sf):
    df = wh.dataset(spark, sf).withColumn("value", F.when(F.col("n") % 10 > 2, F.col("return_5D")).otherwise(F.get(
        F.array(F.lit(float("nan")), F.lit(float("inf")), F.lit(float("-inf"))), (F.col("n") % 10).cast("int"))))
    return cleaning.sanitize(df.select(*KEY, "value"))


@query("redact_public", sql(["dataset"], """
  select feature, symbol, quarter, year, score from (select *, row_number() over (partition by feature order by score desc, symbol, year, quarter) as place
  from long where score is not null) x where place <= 3""", long=long_sql("dataset", FEATS, "symbol, year, quarter")))
def q_redact(spark, sf):
    rows = wh.dataset(spark, sf).withColumn("evidence", F.concat(F.lit("over "), F.col("n").cast("string"), F.lit(" lines")))
    samples = signals.sample_extremes(rows, FEATS, ["evidence"], ["symbol", "year", "quarter"]).where("side = 'top'")
    nested = samples.groupBy("feature").agg(F.collect_list(F.struct("symbol", "quarter", "year", "score", "evidence")).alias("samples"))
    return cleaning.redact_samples(nested).select("feature", F.explode("samples").alias("s")).select("feature", "s.*")


@query("prune_weights", sql(["dataset"], "select feature, horizon, round(ic, 4) + 0 as weight from ic where abs(round(ic, 4)) > 0.01",
       pairs=pairs_sql("dataset", FEATS, RETS), ranked=RANKED, ic=ic_sql(20)))
def q_prune(spark, sf):
    weights = signals.rounded(signals.feature_ic(staged(spark, sf), FEATS, RETS)).select("feature", "horizon", F.col("ic").alias("weight"))
    return cleaning.prune_weights(weights, 0.01)


# --- joins ------------------------------------------------------------------------------------


@query("join_features_returns", sql(["scores", "returns"], "select symbol, quarter, year, mgmt_hedging as feat_mgmt_hedging, "
       "pricing_power as feat_pricing_power, return_5D from scores join returns using (symbol, quarter, year)"))
def q_join_features(spark, sf):
    scores = cleaning.known_features(wh.analysis(spark, sf), KEY)
    return wh.price_cache(spark, sf).join(scores, KEY).select(*KEY, "feat_mgmt_hedging", "feat_pricing_power", "return_5D")


@query("join_event_date", sql(["transcripts"], """
  select k.ticker, k.quarter, k.year, f.earnings_date from (select distinct ticker, quarter, year from transcripts) k
  left join (select ticker, quarter, year, earnings_date from (select *, row_number() over (partition by ticker, quarter, year order by doc_id) as rn
             from transcripts where length(earnings_date) > 0) x where rn = 1) f using (ticker, quarter, year)"""))
def q_event_date(spark, sf):
    t = wh.transcripts(spark, sf).drop("transcript")
    return joins.event_dates(t.select(*TKEY).distinct(), t, TKEY, "doc_id")


@query("merge_new_transcripts", sql(["transcripts"], """
  select doc_id, ticker, quarter, year from cache union all
  select doc_id, ticker, quarter, year from (select *, row_number() over (partition by ticker, quarter, year order by doc_id) as rn from transcripts) x
  where rn = 1 and (ticker, quarter, year) not in (select (ticker, quarter, year) from cache)""",
    cache="select t.doc_id, ticker, quarter, year from transcripts t join documents d using (doc_id) where d.lang = 'fr'"))
def q_merge(spark, sf):
    t = wh.transcripts(spark, sf).select("doc_id", *TKEY)
    french = wh.read(spark, sf, "documents").where("lang = 'fr'").select("doc_id")
    return joins.merge_new(t.join(french, "doc_id", "left_semi"), t, TKEY, "doc_id")


@query("pending_analysis", sql(["transcripts"], "select doc_id, ticker, quarter, year from transcripts where doc_id not in (select doc_id from labels)"))
def q_pending(spark, sf):
    done = wh.read(spark, sf, "labels")
    return joins.pending(wh.transcripts(spark, sf).select("doc_id", *TKEY), done, ["doc_id"])


TODAY = dt.date(2001, 6, 1)
_ANY_NULL = " or ".join(f"r.return_{h} is null" for h in HORIZON_ORDER)


@query("refresh_due", sql(["ev", "returns_short"], f"""
  select * from (select ev.symbol, ev.quarter, ev.year, ev.event_date, case when r.symbol is null then 'new' when {_ANY_NULL} then 'incomplete returns'
     when date '2001-06-01' - ev.event_date < 35 then 'recent' end as reason
  from ev left join returns_short r on r.symbol = ev.symbol and r.quarter = ev.quarter and r.year = ev.year) x where reason is not null"""))
def q_refresh_due(spark, sf):
    return joins.refresh_due(wh.events(spark, sf), wh.price_cache(spark, sf, 30), TODAY)


@query("diff_refresh", sql(["returns_short", "returns"], " union all ".join(f"""
  select o.symbol, o.quarter, o.year, '{h}' as horizon, o.return_{h} as old_value, w.return_{h} as new_value
  from returns_short o join returns w using (symbol, quarter, year)
  where (o.return_{h} is null and w.return_{h} is not null) or abs(o.return_{h} - w.return_{h}) > 0.01""" for h in HORIZON_ORDER)))
def q_diff(spark, sf):
    return joins.refresh_changes(wh.price_cache(spark, sf, 30), wh.price_cache(spark, sf))


@query("src_price_bars", sql(["ev", "bars"], """
  select ev.symbol, ev.quarter, ev.year, ev.event_date, b.date, b.close from ev join bars b on b.symbol = ev.symbol
   and b.date >= ev.event_date - 5 and b.date < ev.event_date + 40"""))
def q_price_bars(spark, sf):
    return price_window(wh.events(spark, sf), wh.bars(spark, sf))


@query("asof_forward", sql(["ev", "bars"], """
  select symbol, quarter, year, event_date, date as base_date, close from (
    select ev.*, b.date, b.close, row_number() over (partition by ev.symbol, ev.event_date order by b.date) as rn
    from ev join bars b on b.symbol = ev.symbol and b.date >= ev.event_date and b.date <= ev.event_date + 40) x where rn = 1"""))
def q_asof_forward(spark, sf):
    return joins.asof_forward(wh.events(spark, sf), wh.bars(spark, sf), 40).select(*KEY, "event_date", "base_date", "close")


@query("asof_backward", sql(["ev", "bars"], """
  select symbol, quarter, year, event_date, date as prev_date, close as prev_close from (
    select ev.*, b.date, b.close, row_number() over (partition by ev.symbol, ev.event_date order by b.date desc) as rn
    from ev left join bars b on b.symbol = ev.symbol and b.date < ev.event_date and b.date >= ev.event_date - 5) x where rn = 1"""))
def q_asof_backward(spark, sf):
    return joins.asof_backward(wh.events(spark, sf), wh.bars(spark, sf)).select(*KEY, "event_date", "prev_date", "prev_close")


RETURN_COLS = ", ".join(f"return_{h}" for h in HORIZON_ORDER)


@query("forward_returns", sql(["returns"], f"select symbol, quarter, year, event_date, {RETURN_COLS} from returns"))
def q_forward(spark, sf):
    return wh.price_cache(spark, sf).drop("return_earnings_day")


@query("forward_returns_immature", sql(["returns_short"], f"select symbol, quarter, year, event_date, {RETURN_COLS} from returns_short"))
def q_forward_short(spark, sf):
    return forward_returns(wh.events(spark, sf), wh.bars(spark, sf), 30).drop("return_earnings_day")


@query("event_day_return", sql(["returns"], "select symbol, quarter, year, return_earnings_day from returns"))
def q_event_day(spark, sf):
    return wh.price_cache(spark, sf).select(*KEY, "return_earnings_day")


@query("join_sources", sql(["filings", "scores"], """
  select s.symbol, s.quarter, s.year, f.filingDate, f.riskScore, s.mgmt_hedging as feat_mgmt_hedging
  from filings f join scores s on s.symbol = upper(f.ticker) and s.quarter = quarter(cast(f.filingDate as date))
   and s.year = year(cast(f.filingDate as date))"""))
def q_join_sources(spark, sf):
    filings = cleaning.filing_keys(wh.filings(spark, sf))
    scores = cleaning.known_features(wh.analysis(spark, sf), KEY)
    return joins.join_sources(filings, scores).select(*KEY, "filingDate", "riskScore", "feat_mgmt_hedging")


META_SQL = " union all ".join(
    "select '{}' as feature, '{}' as name, '{}' as category, {} as bear".format(f, n.replace("'", "''"), c, str(b).lower())
    for f, n, c, b in TRANSCRIPT_FEATURES)


def feature_meta(spark):
    return spark.createDataFrame(TRANSCRIPT_FEATURES, "feature string, name string, category string, bear boolean")


@query("join_feature_meta", sql(["dataset"], "select m.feature, m.name, m.category, m.bear, count(l.score) as n, round(avg(l.score), 6) as mean "
       "from meta m join long l using (feature) group by all", long=long_sql("dataset", FEATS, "symbol"), meta=META_SQL))
def q_meta(spark, sf):
    long = wh.dataset(spark, sf).select(*[F.col(c).alias(f) for f, c in FEATS.items()]).unpivot([], list(FEATS), "feature", "score")
    means = long.groupBy("feature").agg(F.count("score").alias("n"), F.round(F.avg("score"), 6).alias("mean"))
    return means.join(F.broadcast(feature_meta(spark)), "feature")  # 16 fixed rows


FIRMS = ["NATION_1", "NATION_7"]


@query("lookback_activity", sql(["ev", "actions"], """
  select ev.symbol, ev.quarter, ev.year, ev.event_date, count(case when a.action_type = 'upgrade' then 1 end) as upgrades_last_30d,
    count(case when a.action_type = 'downgrade' and (contains(a.firm, 'NATION_1') or contains(a.firm, 'NATION_7')) then 1 end) as major_downgrades_last_30d
  from ev left join actions a on a.symbol = ev.symbol and a.activity_date >= ev.event_date - 30 and a.activity_date < ev.event_date
  group by 1, 2, 3, 4"""))
def q_lookback(spark, sf):
    return joins.lookback_activity(wh.events(spark, sf), wh.actions(spark, sf), FIRMS).select(
        *KEY, "event_date", "upgrades_last_30d", "major_downgrades_last_30d")


ACTUALS_SQL = """
  select ticker, filingDate, round(sentimentScore * 10, 4) as predicted, actual30dReturn as actual_return, spxReturn30d as index_return,
    round(actual30dReturn - spxReturn30d, 4) as actual_alpha from filings"""


def _predictions_and_actuals(spark, sf):
    f = stage(wh.filings(spark, sf).select("ticker", "filingDate", "sentimentScore", "actual30dReturn", "spxReturn30d"), "filings")
    predictions = f.select("ticker", "filingDate", F.round(F.col("sentimentScore") * 10, 4).alias("predicted"))
    return predictions, f.select("ticker", "filingDate", F.col("actual30dReturn").alias("actual_return"), F.col("spxReturn30d").alias("index_return"))


@query("join_actuals", sql(["filings"], ACTUALS_SQL))
def q_actuals(spark, sf):
    return joins.join_actuals(*_predictions_and_actuals(spark, sf), ["ticker", "filingDate"])


@query("join_actuals_matured", sql(["filings"], ACTUALS_SQL + " where cast(filingDate as date) + 35 <= (select max(cast(filingDate as date)) from filings)"))
def q_actuals_matured(spark, sf):
    """Predictions that were made 35 days before the newest filing or earlier."""
    predictions, actuals = _predictions_and_actuals(spark, sf)
    newest = predictions.agg(F.max(F.col("filingDate").cast("date"))).first()[0]
    return joins.join_actuals(predictions, actuals, ["ticker", "filingDate"], "filingDate", newest)


@query("price_ratios", sql(
    ["bars"], """
  select symbol, date, round(close / max(close) over (w rows between 251 preceding and current row), 6) as price_to_high,
    round(close / min(close) over (w rows between 251 preceding and current row), 6) as price_to_low,
    round(close / avg(close) over (w rows between 29 preceding and current row), 6) as price_to_ma30,
    round(close / avg(close) over (w rows between 49 preceding and current row), 6) as price_to_ma50,
    round((close / lag(close, 30) over w - 1) * 100, 6) as return_30d,
    round(stddev_samp(case when previous <> 0 then (close - previous) / previous * 100 end) over (w rows between 29 preceding and current row) * sqrt(252), 6) as volatility30,
    round(case when gain + loss > 0 then gain / (gain + loss) * 100 end, 6) as rsi14, round(fast - slow, 6) + 0 as macd
  from smooth window w as (partition by symbol order by date)""",
    numbered="select *, row_number() over w as k, lag(close) over w as previous from bars window w as (partition by symbol order by date)",
    smooth="""select * from (
      with recursive step as (
        select symbol, date, close, k, previous, close as fast, close as slow, cast(null as double) as gain, cast(null as double) as loss from numbered where k = 1
        union all
        select n.symbol, n.date, n.close, n.k, n.previous, s.fast + (n.close - s.fast) * 2 / 13e0, s.slow + (n.close - s.slow) * 2 / 27e0,
          coalesce(s.gain + (greatest(n.close - n.previous, 0) - s.gain) / 14e0, greatest(n.close - n.previous, 0)),
          coalesce(s.loss + (greatest(n.previous - n.close, 0) - s.loss) / 14e0, greatest(n.previous - n.close, 0))
        from step s join numbered n on n.symbol = s.symbol and n.k = s.k + 1)
      select * from step) r"""))
def q_price_ratios(spark, sf):
    """Eight rolling and smoothed price features per bar."""
    return signals.rounded(technical.price_features(wh.bars(spark, sf)), 6)
