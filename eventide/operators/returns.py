"""Forward returns of events from daily bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.definitions import HORIZONS, LEAD_IN_DAYS, WINDOW_BUFFER_DAYS


def first_bars(events: DataFrame, bars: DataFrame, reach: int, horizons: dict[str, int]) -> DataFrame:
    """(symbol, event_date) of the events with the first bar on or after the date, and that bar's neighbours.

    Bars and event dates hold one row per symbol and day, so a symbol's list of bars is bounded by the calendar. Dates and bars
    are put in one order while they are narrow, a date before the bar of its day; a date's place in the list is the bars so far.
    """
    bar = F.struct("date", "close")
    known = bars.select("symbol", F.col("date").alias("event_date"), bar.alias("bar"), F.lit(1).alias("_kind"))
    dates = events.select("symbol", "event_date").distinct()
    asked = dates.select("symbol", "event_date", F.lit(None).cast(known.schema["bar"].dataType).alias("bar"), F.lit(0).alias("_kind"))
    so_far = Window.partitionBy("symbol").orderBy("event_date", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = known.unionByName(asked).withColumn("_at", F.count("bar").over(so_far).cast("int"))
    listed = placed.groupBy("symbol").agg(
        F.sort_array(F.collect_list("bar")).alias("bars"),
        F.collect_list(F.when(F.col("_kind") == 0, F.struct("event_date", "_at"))).alias("asked"),
    )

    def found(e: Column) -> Column:
        at = lambda k: F.get("bars", e["_at"] + k)
        return F.struct(
            e["event_date"].alias("event_date"), at(0)["date"].alias("date"), at(0)["close"].alias("close"),
            *[at(i)["date"].alias(f"lead_date_{i}") for i in range(1, LEAD_IN_DAYS)],
            *[at(-i)["date"].alias(f"lag_date_{i}") for i in range(1, LEAD_IN_DAYS + 1)],
            *[at(k)["close"].alias(f"close_{label}") for label, k in horizons.items()],
            *[at(k)["date"].alias(f"date_{label}") for label, k in horizons.items()],
            at(-1)["close"].alias("prev_close"),
        )

    rows = listed.select("symbol", F.explode(F.transform("asked", found)).alias("e")).select("symbol", "e.*")
    return rows.where(F.col("date") <= F.date_add("event_date", reach))


def price_window(events: DataFrame, bars: DataFrame, days_after: int = 30) -> DataFrame:
    """All bars of an event in [event - 5 days, event + days_after + 10 days), end exclusive.

    Output rows are the bars asked for: at most one per calendar day of the window and event.
    """
    start, end = F.date_sub("event_date", LEAD_IN_DAYS), F.date_add("event_date", days_after + WINDOW_BUFFER_DAYS)
    width = LEAD_IN_DAYS + days_after + WINDOW_BUFFER_DAYS
    slot = lambda day: F.floor(F.unix_date(day) / width)
    # a window lies in two slots of its own width at most; the events are many more than their source's size suggests: no broadcast
    asked = events.withColumn("_slot", F.explode(F.array(slot(start), slot(start) + 1))).hint("merge")
    found = asked.join(bars.withColumn("_slot", slot(F.col("date"))), ["symbol", "_slot"])
    return found.where((F.col("date") >= start) & (F.col("date") < end)).select(
        "symbol", "date", *[c for c in events.columns if c != "symbol"], *[c for c in bars.columns if c not in ("symbol", "date")])


def forward_returns(
    events: DataFrame,
    bars: DataFrame,
    days_after: int = 30,
    horizons: dict[str, int] = HORIZONS,
) -> DataFrame:
    """Percent returns k bars after the first bar on or after ``event_date``.

    Events need five bars in the window and two from the event on; a horizon whose bar lies
    outside the window is NULL. ``return_earnings_day`` is against the last bar before the event,
    inside the five-day lead-in.
    """
    reach = days_after + WINDOW_BUFFER_DAYS
    first = first_bars(events, bars, reach, horizons)
    e = F.col("event_date")
    end = F.date_add(e, reach)
    first_day = F.date_sub(e, LEAD_IN_DAYS)

    def one(cond):
        return F.when(cond, 1).otherwise(0)

    before = sum((one(F.col(f"lag_date_{i}") >= first_day) for i in range(1, LEAD_IN_DAYS + 1)), F.lit(0))
    after = sum((one(F.col(f"lead_date_{i}") < end) for i in range(1, LEAD_IN_DAYS)), one(F.col("date") < end))

    def pct(later, base):
        return F.round((later - base) / base * 100, 4)

    returns = [
        F.when(F.col(f"date_{h}") < end, pct(F.col(f"close_{h}"), F.col("close"))).alias(f"return_{h}")
        for h in horizons
    ]
    day_return = F.when(
        F.col("lag_date_1") >= first_day, pct(F.col("close"), F.col("prev_close"))
    ).alias("return_earnings_day")
    # as in price_window, the events' source says little about their number, and a broadcast would go through the driver
    matched = events.hint("merge").join(first, ["symbol", "event_date"])
    return matched.where((before + after >= 5) & (F.col("lead_date_1") < end)).select(
        *events.columns, *returns, day_return
    )
