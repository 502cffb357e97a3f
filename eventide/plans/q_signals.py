"""Queries over feature statistics, correlations and combinations."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.definitions import (BEARISH, COMBOS, FILING_FEATURES, FILING_RENAME, FILING_TARGETS,
                                  HORIZON_ORDER, KNOWN_FEATURES)
from eventide.operators import rankcorr, signals
from eventide.operators.ordering import avg_rank
from eventide.plans.oracle_tables import sql
from eventide.plans.registry import query
from eventide.session import stage
from eventide.sources import warehouse as wh

FEATS = {f: f"feat_{f}" for f in KNOWN_FEATURES}
RETS = {h: f"return_{h}" for h in HORIZON_ORDER}
FILING_FEATS = {snake: raw for raw, snake in FILING_RENAME.items()}
FILING_BEAR = {snake for _, snake, _, _, bear in FILING_FEATURES if bear}


def quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in sorted(names))


def long_sql(table: str, feats: dict[str, str], keep: str, value: str = "score") -> str:
    return " union all ".join(
        f"select {keep}, '{f}' as feature, cast({c} as double) as {value} from {table}" for f, c in feats.items()
    )


def pairs_sql(table: str, feats: dict[str, str], rets: dict[str, str]) -> str:
    """Every feature with every horizon of a row, from one scan of the table."""
    scores = ", ".join(f"{{'feature': '{f}', 'score': cast({c} as double)}}" for f, c in feats.items())
    returns = ", ".join(f"{{'horizon': '{h}', 'ret': {r}}}" for h, r in rets.items())
    return f"""
  select x.feature as feature, y.horizon as horizon, x.score as score, y.ret as ret
  from (select x, unnest(ys) as y from (select unnest([{scores}]) as x, [{returns}] as ys from {table}) a) b
  where x.score is not null and y.ret is not null"""


RANKED = """
  select feature, horizon, score, ret,
    rank() over (partition by feature, horizon order by score)
      + (count(*) over (partition by feature, horizon, score) - 1) / 2e0 as rx,
    rank() over (partition by feature, horizon order by ret)
      + (count(*) over (partition by feature, horizon, ret) - 1) / 2e0 as ry
  from pairs"""


def ic_sql(min_n: int) -> str:
    return f"""
  select feature, horizon, count(*) as n,
    case when min(rx) < max(rx) and min(ry) < max(ry) then corr(rx, ry) end as ic
  from ranked group by feature, horizon having count(*) >= {min_n}"""


# two-sided t-test by Simpson's rule on the cosine form of the t density
PVALUE = """
  select feature, horizon, n, ic,
    2 * exp(lgamma((n - 1) / 2e0) - lgamma((n - 2) / 2e0)) / sqrt(pi()) * (pi() / 2 - lower) / 30000 / 3
      * sum(case when i = 0 or i = 30000 then 1 when i % 2 = 1 then 4 else 2 end
            * pow(cos(lower + (pi() / 2 - lower) * i / 30000), n - 3)) as ic_pvalue
  from (select ic.*, atan(abs(ic) / sqrt(1 - ic * ic)) as lower from ic) z,
       (select unnest(range(0, 30001)) as i) g
  group by feature, horizon, n, ic, lower"""


def stats_sql(bear, mode: str = "fixed", small_n: str = "neutral", min_n: int = 20) -> str:
    predict = "0.5e0" if mode == "fixed" else "median(score) over (partition by feature, horizon)"
    trigger = "0.6e0" if mode == "fixed" else "quantile_cont(score, 0.75) over (partition by feature, horizon)"
    few = "1" if small_n == "neutral" else "0"
    return f"""
  select feature, horizon,
    avg(case when (score > predict) = (case when bear then ret < 0 else ret > 0 end) then 1e0 else 0e0 end) as accuracy,
    case when count(sig) > 1 and min(sig) < max(sig) then avg(sig) / stddev_pop(sig) * 2 else 0e0 end as sharpe,
    case when count(sig) > 1 then avg(sig) else 0e0 end as avg_return_pct,
    case when count(sig) > {few} then avg(case when sig > 0 then 1e0 when sig is not null then 0e0 end) else 0.5e0 end as win_rate,
    count(*) as n_observations, count(sig) as n_signal_triggered
  from (select p.*, case when score > trig then case when bear then -ret else ret end end as sig
        from (select feature, horizon, score, ret, feature in ({quoted(bear)}) as bear,
                     {predict} as predict, {trigger} as trig from pairs) p) s
  group by feature, horizon having count(*) >= {min_n}"""


def rounded_sql(cols: str, places: int = 4) -> str:
    return ", ".join(f"round({c}, {places}) + 0 as {c}" for c in cols.split())


STAT_COLS = "accuracy sharpe avg_return_pct win_rate"


def table_sql(tables, source, feats, rets, bear, mode="fixed", small_n="neutral", min_n=20) -> str:
    return sql(
        tables,
        f"select feature, horizon, {rounded_sql(STAT_COLS + ' ic ic_pvalue')}, n_observations, n_signal_triggered "
        "from stats join pv using (feature, horizon)",
        pairs=pairs_sql(source, feats, rets), ranked=RANKED, ic=ic_sql(min_n), pv=PVALUE,
        stats=stats_sql(bear, mode, small_n, min_n),
    )


def staged(spark, sf):
    return rankcorr.with_row_id(wh.dataset(spark, sf), "dataset")


def staged_filings(spark, sf):
    return rankcorr.with_row_id(wh.filings(spark, sf), "filings")


FILING_SQL_FEATS = {s: r for s, r in FILING_FEATS.items()}


@query("feature_ic", sql(["dataset"], "select feature, horizon, n, round(ic, 4) + 0 as ic from ic",
                         pairs=pairs_sql("dataset", FEATS, RETS), ranked=RANKED, ic=ic_sql(20)))
def q_feature_ic(spark, sf):
    return signals.rounded(signals.feature_ic(staged(spark, sf), FEATS, RETS))


@query("feature_ic_filings", sql(["filings"], "select feature, horizon, n, round(ic, 4) + 0 as ic from ic",
                                 pairs=pairs_sql("filings", FILING_FEATS, FILING_TARGETS), ranked=RANKED, ic=ic_sql(20)))
def q_feature_ic_filings(spark, sf):
    return signals.rounded(signals.feature_ic(staged_filings(spark, sf), FILING_FEATS, FILING_TARGETS))


@query("ic_pvalue", sql(["dataset"], "select feature, horizon, n, round(ic * sqrt((n - 2) / (1 - ic * ic)), 4) + 0 as t, "
                        "round(ic_pvalue, 4) as ic_pvalue from pv",
                        pairs=pairs_sql("dataset", FEATS, RETS), ranked=RANKED, ic=ic_sql(20), pv=PVALUE))
def q_ic_pvalue(spark, sf):
    ic = signals.with_pvalue(signals.feature_ic(staged(spark, sf), FEATS, RETS))
    t = F.col("ic") * F.sqrt((F.col("n") - 2) / (1 - F.col("ic") * F.col("ic")))
    return signals.rounded(ic.select("feature", "horizon", "n", t.alias("t"), "ic_pvalue"))


def _stats_oracle(tables, source, feats, rets, bear, cols, **kw):
    ints = [c for c in cols if c.startswith("n_")]
    real = " ".join(c for c in cols if not c.startswith("n_"))
    return sql(tables, f"select feature, horizon, {rounded_sql(real)}{''.join(', ' + c for c in ints)} from stats",
               pairs=pairs_sql(source, feats, rets), stats=stats_sql(bear, **kw))


ACCURACY = ["accuracy", "n_observations"]
RETURNS = ["sharpe", "avg_return_pct", "win_rate", "n_signal_triggered"]


def _stats(df, feats, rets, bear, cols, **kw):
    groups = signals.score_groups(df, feats, rets)
    return signals.rounded(signals.signal_stats(groups, bear, **kw).select("feature", "horizon", *cols))


def _register_stats(name, cols, filings, **kw):
    args = (FILING_FEATS, FILING_TARGETS, FILING_BEAR) if filings else (FEATS, RETS, BEARISH)
    source = "filings" if filings else "dataset"
    adapter = wh.filings if filings else wh.dataset

    @query(name, _stats_oracle([source], source, *args, cols, **kw))
    def run(spark, sf):
        return _stats(adapter(spark, sf), *args, cols, **kw)


_register_stats("dir_accuracy_fixed", ACCURACY, False)
_register_stats("dir_accuracy_median", ACCURACY, True, mode="quantile")
_register_stats("signal_stats_fixed", RETURNS, False)
_register_stats("signal_stats_quartile", RETURNS, True, mode="quantile")
_register_stats("signal_stats_combined", RETURNS, True, mode="quantile", small_n="observed", min_n=15)


def signal_table(spark, sf):
    return signals.feature_signal_table(staged(spark, sf), FEATS, RETS, BEARISH)


@query("feature_signal_table", table_sql(["dataset"], "dataset", FEATS, RETS, BEARISH))
def q_feature_signal_table(spark, sf):
    return signal_table(spark, sf)


@query("feature_signal_table_filings",
       table_sql(["filings"], "filings", FILING_FEATS, FILING_TARGETS, FILING_BEAR, mode="quantile"))
def q_feature_signal_table_filings(spark, sf):
    return signals.feature_signal_table(staged_filings(spark, sf), FILING_FEATS, FILING_TARGETS, FILING_BEAR, "quantile")


def _corr_sql(source: str, feats: dict[str, str], keep: str) -> dict[str, str]:
    names = sorted(feats)
    both = " union all ".join(
        f"select '{a}' as feature, '{b}' as horizon, cast({feats[a]} as double) as score, "
        f"cast({feats[b]} as double) as ret from {source} where {feats[a]} is not null and {feats[b]} is not null"
        for i, a in enumerate(names) for b in names[i + 1:]
    )
    return {
        "pairs": both, "ranked": RANKED, "ic": ic_sql(1),
        "upper": "select feature as f1, horizon as f2, round(ic, 3) as r from ic",
        "ones": " union all ".join(
            f"select '{a}' as f1, '{a}' as f2, case when min({c}) < max({c}) then 1e0 end as r from {source} "
            f"having count({c}) > 0" for a, c in feats.items()),
    }


MATRIX = ("select f1, f2, r + 0 as r from upper union all select f2, f1, r + 0 from upper "
          "union all select f1, f2, r from ones")


def matrix(spark, sf):
    df = rankcorr.with_row_id(
        wh.dataset(spark, sf).select(*[F.col(c).alias(f) for f, c in FEATS.items()]), "features")
    return rankcorr.correlation_matrix(df, KNOWN_FEATURES)


@query("corr_matrix", sql(["dataset"], MATRIX, **_corr_sql("dataset", FEATS, "n")))
def q_corr_matrix(spark, sf):
    return signals.rounded(matrix(spark, sf), 3)


@query("corr_matrix_filings", sql(["filings"], MATRIX, **_corr_sql("filings", FILING_FEATS, "ticker")))
def q_corr_matrix_filings(spark, sf):
    df = rankcorr.with_row_id(
        wh.filings(spark, sf).select(*[F.col(c).alias(f) for f, c in FILING_FEATS.items()]), "features")
    return signals.rounded(rankcorr.correlation_matrix(df, list(FILING_FEATS)), 3)


@query("notable_corr", sql(["dataset"], "select f1, f2, r + 0 as r from upper where abs(r) > 0.4",
                           **_corr_sql("dataset", FEATS, "n")))
def q_notable_corr(spark, sf):
    return signals.rounded(rankcorr.notable_correlations(matrix(spark, sf)), 3)


@query("pair_features", sql(["dataset"], "select a.feature as f1, b.feature as f2, least(a.n, b.n) as n_max from present a "
       "join present b on a.feature < b.feature", long=long_sql("dataset", FEATS, "symbol"),
       present="select feature, count(score) as n from long group by 1 having count(score) > 0"))
def q_pair_features(spark, sf):
    """Pairs f1 < f2 of the features that hold data, with the most rows they can share."""
    long = wh.dataset(spark, sf).select(*[F.col(c).alias(f) for f, c in FEATS.items()]).unpivot([], list(FEATS), "feature", "score")
    present = long.groupBy("feature").agg(F.count("score").alias("n")).where("n > 0")
    # one row per feature column, so the list is as short as the schema
    ordered = present.agg(F.sort_array(F.collect_list(F.struct("feature", "n"))).alias("all"))
    first = ordered.select("all", F.posexplode("all").alias("i", "a"))
    pairs = first.select("a", F.explode(F.expr("slice(all, i + 2, size(all))")).alias("b"))
    return pairs.select(F.col("a.feature").alias("f1"), F.col("b.feature").alias("f2"), F.least("a.n", "b.n").alias("n_max"))


def _combo_sql() -> str:
    out = []
    for name, direction, terms in COMBOS:
        cond = " and ".join(
            f"feat_{f} {'<' if direction == 'bullish' and t < 0.5 else '>'} {t}e0" for f, t in terms)
        there = " and ".join(f"feat_{f} is not null" for f, _ in terms) + " and return_5D is not null and return_10D is not null"
        for h in ("5D", "10D"):
            r = f"case when {cond} then {'-' if direction == 'bearish' else ''}return_{h} end"
            out.append(f"""
  select '{name}' as name, [{', '.join(f"'{f}'" for f, _ in terms)}] as features, '{h}' as period,
    avg(r) as a, stddev_samp(r) as d, avg(case when r > 0 then 1e0 when r is not null then 0e0 end) as w,
    count(r) as n_triggered, count(*) as n_total
  from (select {r} as r from dataset where {there}) x""")
    return " union all ".join(out)


@query("combo_signals", sql(["dataset"], """
  select name, features, period, round(case when d > 0 then a / d * 2 else 0 end, 3) as sharpe, round(a, 3) as avg_return,
    round(w, 3) as win_rate, n_triggered, n_total from combos where n_total >= 15 and n_triggered >= 3""", combos=_combo_sql()))
def q_combo_signals(spark, sf):
    return signals.combo_signals(wh.dataset(spark, sf), COMBOS, {"5D": "return_5D", "10D": "return_10D"})


@query("view_combos", sql(["dataset"], """
  select row_number() over (order by abs(round(case when d > 0 then a / d * 2 else 0 end, 3)) desc, name, period) as place,
    name, period, round(case when d > 0 then a / d * 2 else 0 end, 3) as sharpe
  from combos where n_total >= 15 and n_triggered >= 3""", combos=_combo_sql()))
def q_view_combos(spark, sf):
    from eventide.operators.views import view_combos

    return view_combos(q_combo_signals(spark, sf)).select("place", "name", "period", "sharpe")


@query("feature_percentiles", sql(["dataset"], f"""
  select feature, {', '.join(f'round(quantile_cont(score, {q}), 4) as {n}' for n, q in (('p25', .25), ('p50', .5), ('p75', .75)))},
    round(avg(score), 4) as mean, round(stddev_pop(score), 4) as std
  from long where score is not null group by feature""", long=long_sql("dataset", FEATS, "symbol")))
def q_feature_percentiles(spark, sf):
    return signals.rounded(signals.feature_summary(wh.dataset(spark, sf), FEATS))


@query("scaler_fit", sql(["dataset"], """
  select feature, count(score) as n, round(avg(score), 6) as mean,
    round(case when stddev_pop(score) > 1e-9 then stddev_pop(score) else 1 end, 6) as std
  from long group by feature""", long=long_sql("dataset", FEATS, "symbol")))
def q_scaler_fit(spark, sf):
    return signals.rounded(signals.scaler_fit(wh.dataset(spark, sf), FEATS), 6)


@query("sample_extremes", sql(["dataset"], """
  select feature, side, place, symbol, quarter, year, round(score, 2) as score, return_5D, return_10D from (
    select *, 'top' as side, row_number() over (partition by feature order by score desc, symbol, year, quarter) as place
    from long where score is not null
    union all
    select *, 'bottom', row_number() over (partition by feature order by score, symbol desc, year desc, quarter desc)
    from long where score is not null) x where place <= 3""",
    long=long_sql("dataset", FEATS, "symbol, year, quarter, return_5D, return_10D")))
def q_sample_extremes(spark, sf):
    data = stage(wh.dataset(spark, sf), "dataset")  # read once for each end
    out = signals.sample_extremes(data, FEATS, ["return_5D", "return_10D"], ["symbol", "year", "quarter"])
    return out.select("feature", "side", "place", "symbol", "quarter", "year",
                      F.round("score", 2).alias("score"), "return_5D", "return_10D")


@query("avg_rank", sql(["dataset"], """
  select feature, symbol, quarter, year, score, rank() over (partition by feature order by score)
     + (count(*) over (partition by feature, score) - 1) / 2e0 as rank
  from long where score is not null""", long=long_sql("dataset", FEATS, "symbol, quarter, year")))
def q_avg_rank(spark, sf):
    keep = ["symbol", "quarter", "year"]
    data = stage(wh.dataset(spark, sf), "dataset")  # ranked, then joined with its ranks
    long = data.select(*keep, *[F.col(c).alias(f) for f, c in FEATS.items()]).unpivot(
        keep, list(FEATS), "feature", "score").where("score is not null")
    return avg_rank(long, ["feature"], "score", "rank").select("feature", *keep, "score", "rank")


@query("best_period", sql(["dataset"], """
  select feature, arg_max(horizon, abs(round(ic, 4)) - place * 1e-9) as horizon, arg_max(round(ic, 4) + 0, abs(round(ic, 4)) - place * 1e-9) as ic
  from (select *, list_position(['1D', '5D', '10D', '21D'], horizon) as place from ic where ic is not null) x group by feature""",
    pairs=pairs_sql("dataset", FEATS, RETS), ranked=RANKED, ic=ic_sql(20)))
def q_best_period(spark, sf):
    ic = signals.rounded(signals.feature_ic(staged(spark, sf), FEATS, RETS)).select("feature", "horizon", "ic")
    return signals.best_period(ic, HORIZON_ORDER)
