"""Shapes star-schema tables into the event-study data model.

``bars`` daily closes, ``events`` symbol-quarters, ``dataset`` features joined with forward
returns, ``filings`` a second feature family, ``transcripts`` dated documents and ``actions``
analyst activity. The aggregate and score expressions below use integer arithmetic, so that a
score does not depend on the order in which rows are summed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.definitions import HORIZON_ORDER, KNOWN_FEATURES
from eventide.operators.returns import forward_returns

DAYS_AFTER = 120
LOOKBACK_DAYS = 90

# Volume-weighted average price of a day, in whole cents.
CLOSE = ("floor(sum(cast(round(l_extendedprice * 100) as bigint))"
         " / (1e0 * sum(cast(l_quantity as bigint)))) / 1e2")
# Mean of a four-place return, cut to four places.
MARKET_MEAN = "floor(sum(cast(round({0} * 10000) as bigint)) / (1e0 * count({0}))) / 1e4"
# Integer sums over the line items in the 90 days before an event.
LINE_SUMS = {
    "n": "count(*)",
    "disc": "sum(cast(round(l_discount * 100) as bigint))",
    "tax": "sum(cast(round(l_tax * 100) as bigint))",
    "qty": "sum(cast(l_quantity as bigint))",
    "n_r": "count(case when l_returnflag = 'R' then 1 end)",
    "n_a": "count(case when l_returnflag = 'A' then 1 end)",
    "n_f": "count(case when l_linestatus = 'F' then 1 end)",
    "n_disc": "count(case when l_discount >= 0.05 then 1 end)",
    "n_qty": "count(case when l_quantity > 18 then 1 end)",
    "n_tax": "count(case when l_tax >= 0.04 then 1 end)",
    "n_low": "count(case when l_linenumber <= 4 then 1 end)",
    "n_part": "count(case when l_partkey % 2 = 0 then 1 end)",
    "n_dear": "count(case when l_extendedprice > 45000 then 1 end)",
    "n_odd": "count(case when l_linenumber % 2 = 1 then 1 end)",
    "n_key": "count(case when l_orderkey % 3 = 0 then 1 end)",
    "n_big": "count(case when l_quantity > 15 then 1 end)",
    "n_rf": "count(case when l_returnflag = 'R' and l_linestatus = 'F' then 1 end)",
}
# feature -> (numerator, denominator); the score is the ratio rounded half up to two places
FEATURE_RATIOS = {
    "mgmt_hedging": ("4 * disc", "25 * n"),
    "mgmt_deflection": ("tax", "7 * n"),
    "mgmt_specificity": ("qty", "50 * n"),
    "mgmt_confidence_shift": ("n_r", "n_r + n_a"),
    "analyst_skepticism": ("n_f", "n"),
    "analyst_surprise": ("n_rf", "n_r"),
    "analyst_focus_cluster": ("n_disc", "n"),
    "guidance_revision_dir": ("n_qty", "n"),
    "guidance_qualifiers": ("n_tax", "n"),
    "new_risk_mention": ("n_low", "n"),
    "macro_blame": ("n_part", "n"),
    "capex_language": ("n_dear", "n"),
    "hiring_language": ("n_odd", "n"),
    "competitive_mentions": ("n_key", "case when n % 11 > 0 then n end"),
    "customer_language": ("n_big", "n"),
    "pricing_power": ("n_dear", "n_qty"),
}


def ratio_score(num: str, den: str) -> str:
    """Two-place ratio in [0, 1] by integer rounding; NULL when the denominator is 0."""
    return (f"case when ({den}) > 0 then "
            f"least(floor((200 * ({num}) + ({den})) / (2e0 * ({den}))) / 1e2, 1e0) end")


# Integer sums over the orders behind those line items, for the filing feature family.
ORDER_SUMS = {
    "n": "count(*)",
    "tot": "sum(cast(round(o_totalprice * 100) as bigint))",
    "hi": "max(cast(round(o_totalprice * 100) as bigint))",
    "lo": "min(cast(round(o_totalprice * 100) as bigint))",
    "u1": "count(case when o_orderpriority = '1-URGENT' then 1 end)",
    "u2": "count(case when o_orderpriority = '2-HIGH' then 1 end)",
    "u3": "count(case when o_orderpriority = '3-MEDIUM' then 1 end)",
    "u5": "count(case when o_orderpriority = '5-LOW' then 1 end)",
    "sf": "count(case when o_orderstatus = 'F' then 1 end)",
    "sp": "count(case when o_orderstatus = 'P' then 1 end)",
    "so": "count(case when o_orderstatus = 'O' then 1 end)",
    "qty": "sum(cast(l_quantity as bigint))",
    "disc": "sum(cast(round(l_discount * 100) as bigint))",
}
FILING_EXPRS = {
    "riskScore": "10e0 * u1 / n",
    "sentimentScore": "1e0 * (sf - sp) / n",
    "concernLevel": "10e0 * u5 / n",
    "marketCap": "tot * 1e3",
    "currentPrice": "tot / (n * 1e3)",
    "peRatio": "tot / (1e6 * nullif(u2, 0))",
    "forwardPE": "tot / (1e6 * nullif(u3, 0))",
    "fiftyTwoWeekHigh": "hi / 1e3",
    "fiftyTwoWeekLow": "lo / 1e3",
    "priceToHigh": "tot / (1e0 * n * hi)",
    "priceToLow": "tot / (1e0 * n * lo)",
    "priceToTarget": "case when n % 3 = 0 then tot / (1e0 * n * hi) end",
    "priceToMA30": "case when n % 5 <> 0 then 1e0 * qty / (n * 25) end",
    "priceToMA50": "1e0 * qty / (n * 26)",
    "rsi14": "case when n % 7 <> 0 then 100e0 * sf / n end",
    "macd": "1e0 * (u1 - u2) / n",
    "volatility30": "1e0 * (hi - lo) / hi",
    "return30d": "1e0 * (sf - so)",
    "analystUpsidePotential": "100e0 * (hi - tot / (1e0 * n)) / hi",
    "analystConsensusScore": "1e0 * (u1 + u2) / n",
    "analystCoverage": "n * 1e0",
    "upgradesLast30d": "u1 * 1e0",
    "downgradesLast30d": "u5 * 1e0",
    "netUpgrades": "(u1 - u5) * 1e0",
    "majorUpgrades": "(u1 % 3) * 1e0",
    "majorDowngrades": "(u5 % 3) * 1e0",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol(key: str) -> Column:
    return F.concat(F.lit("S"), F.col(key).cast("string"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, close), at most one row per symbol and calendar day."""
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.to_date("l_shipdate").alias("date"))
        .agg(F.expr(CLOSE).alias("close"))
        .select(symbol("l_suppkey").alias("symbol"), "date", "close")
    )


def event_date(quarter_index: Column) -> Column:
    """The 15th of the middle month of a quarter; index = year * 4 + quarter - 1."""
    return F.make_date(
        F.floor(quarter_index / 4).cast("int"),
        ((quarter_index % 4) * 3 + 2).cast("int"),
        F.lit(15),
    )


def quarters(spark: SparkSession, sf_dir: str) -> list[int]:
    """Quarters whose event has line items in its look-back, by the table's own first and last ship date."""
    shipped = F.to_date("l_shipdate")
    first, last = read(spark, sf_dir, "lineitem").agg(F.min(shipped), F.max(shipped)).first()
    if first is None:
        return []
    dates = {q: dt.date(q // 4, q % 4 * 3 + 2, 15) for q in range(first.year * 4, last.year * 4 + 8)}
    return [q for q, day in dates.items() if first < day <= last + dt.timedelta(days=LOOKBACK_DAYS)]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier x quarter: (symbol, quarter, year, event_date)."""
    return (
        read(spark, sf_dir, "supplier")
        .select(
            symbol("s_suppkey").alias("symbol"),
            F.explode(F.array(*map(F.lit, quarters(spark, sf_dir))).cast("array<int>")).alias("qi"),
        )
        .select(
            "symbol",
            (F.col("qi") % 4 + 1).cast("int").alias("quarter"),
            F.floor(F.col("qi") / 4).cast("int").alias("year"),
            event_date(F.col("qi")).alias("event_date"),
        )
    )


def _to_quarters(lines: DataFrame) -> DataFrame:
    """Each line item with the quarters (``qi``) whose event falls 1..90 days after it was shipped.

    Events are three months apart, so these are the quarter it was shipped in or the next one, if any.
    """
    shipped = F.to_date("l_shipdate")
    own = F.year(shipped) * 4 + F.quarter(shipped) - 1
    days = F.datediff(event_date(F.col("qi")), shipped)
    return (
        lines.withColumn("qi", F.explode(F.array(own, own + 1)))
        .where(days.between(1, LOOKBACK_DAYS))
    )


def _per_event(lines: DataFrame, sums: dict[str, str]) -> DataFrame:
    """(symbol, quarter, year, sums) of the line items of every event, grouped by numbers and named afterwards."""
    return lines.groupBy("l_suppkey", "qi").agg(*[F.expr(e).alias(k) for k, e in sums.items()]).select(
        symbol("l_suppkey").alias("symbol"), (F.col("qi") % 4 + 1).cast("int").alias("quarter"),
        F.floor(F.col("qi") / 4).cast("int").alias("year"), *sums,
    )


def feature_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, quarter, year, n, 16 scores) per event."""
    lines = _to_quarters(read(spark, sf_dir, "lineitem"))
    return _per_event(lines, LINE_SUMS).select(
        "symbol", "quarter", "year", "n",
        *[F.expr(ratio_score(*FEATURE_RATIOS[f])).alias(f) for f in KNOWN_FEATURES],
    )


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, quarter, year, features map) in the shape of extracted documents."""
    entries = []
    for f in KNOWN_FEATURES:
        entries += [
            F.lit(f),
            F.struct(
                F.col(f).alias("score"),
                F.concat(F.lit(f + " over "), F.col("n").cast("string"), F.lit(" lines")).alias("evidence"),
                F.element_at(F.array(F.lit("prepared"), F.lit("qa"), F.lit("both")),
                             (F.col("n") % 3 + 1).cast("int")).alias("section"),
            ),
        ]
    invented = [
        F.lit("invented_extra"),
        F.struct(F.lit(0.5).alias("score"), F.lit("x").alias("evidence"), F.lit("qa").alias("section")),
    ]
    return feature_scores(spark, sf_dir).select(
        "symbol", "quarter", "year", F.create_map(*entries, *invented).alias("features")
    )


def price_cache(spark: SparkSession, sf_dir: str, days_after: int = DAYS_AFTER) -> DataFrame:
    """Forward returns per event, wide."""
    return forward_returns(events(spark, sf_dir), bars(spark, sf_dir), days_after=days_after)


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: feat_* scores joined with return_* columns."""
    scores = feature_scores(spark, sf_dir).select(
        "symbol", "quarter", "year", "n", *[F.col(f).alias(f"feat_{f}") for f in KNOWN_FEATURES]
    )
    returns = price_cache(spark, sf_dir)
    return returns.join(scores, ["symbol", "quarter", "year"]).select(
        "symbol", "quarter", "year",
        F.date_format("event_date", "yyyy-MM-dd").alias("earnings_date"),
        "n",
        *[f"feat_{f}" for f in KNOWN_FEATURES],
        *[f"return_{h}" for h in HORIZON_ORDER],
        "return_earnings_day",
    )


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, filingDate, camelCase features, targets); some symbol-quarters file twice."""
    lines = _to_quarters(read(spark, sf_dir, "lineitem"))
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"
    )
    sums = _per_event(lines.join(orders, lines.l_orderkey == orders.o_orderkey), ORDER_SUMS)
    returns = price_cache(spark, sf_dir).select(
        "symbol", "quarter", "year", "event_date", "return_5D", "return_21D"
    )
    market = returns.groupBy("event_date").agg(
        F.expr(MARKET_MEAN.format("return_5D")).alias("spxReturn7d"),
        F.expr(MARKET_MEAN.format("return_21D")).alias("spxReturn30d"),
    )
    # one row per quarter date: bounded by the calendar
    joined = sums.join(returns, ["symbol", "quarter", "year"]).join(F.broadcast(market), "event_date")
    copies = F.when((F.col("quarter") == 2) & (F.col("n") % 4 == 0), F.array(F.lit(0), F.lit(20))).otherwise(
        F.array(F.lit(0))
    )
    exprs = [F.expr(FILING_EXPRS[c]).alias(c) for c in FILING_EXPRS]
    return joined.withColumn("shift", F.explode(copies)).select(
        F.lower("symbol").alias("ticker"),
        F.date_format(F.date_add("event_date", F.col("shift")), "yyyy-MM-dd").alias("filingDate"),
        *exprs,
        "spxReturn7d", "spxReturn30d",
        (F.lit(10e0) + F.col("quarter") + F.col("year") % 5).alias("vixClose"),
        F.col("return_5D").alias("actual7dReturn"),
        F.col("return_21D").alias("actual30dReturn"),
        F.round(F.col("return_5D") - F.col("spxReturn7d"), 4).alias("actual7dAlpha"),
        F.round(F.col("return_21D") - F.col("spxReturn30d"), 4).alias("actual30dAlpha"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as (doc_id, ticker, quarter, year, transcript, earnings_date)."""
    year = (F.lit(2014) + F.floor(F.col("doc_id") / 4) % 12).cast("int")
    quarter = (F.col("doc_id") % 4 + 1).cast("int")
    day = F.make_date(year, quarter * 3 - 1, F.lit(15))
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("ticker"),
        quarter.alias("quarter"),
        year.alias("year"),
        F.col("text").alias("transcript"),
        F.when(F.col("doc_id") % 7 != 0, F.concat(day.cast("string"), F.lit("T16:30:00"))).alias("earnings_date"),
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as analyst actions: (symbol, activity_date, firm, action_type)."""
    n_symbols = read(spark, sf_dir, "supplier").count()
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("firm"))
    action = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "upgrade")
        .when(F.col("o_orderpriority") == "5-LOW", "downgrade")
        .otherwise("maintain")
    )
    return (
        read(spark, sf_dir, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.lit("S"), (F.col("o_custkey") % n_symbols).cast("string")).alias("symbol"),
            F.to_date("o_orderdate").alias("activity_date"),
            "firm",
            action.alias("action_type"),
        )
    )
