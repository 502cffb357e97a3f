"""The data model as ANSI SQL over the given tables, for the DuckDB side of the checks."""

from __future__ import annotations

from eventide.definitions import HORIZON_ORDER, HORIZONS, KNOWN_FEATURES
from eventide.sources import warehouse as wh

_HIDDEN = ", ".join(f"lead(b.close, {k}) over w as close_{h}, lead(b.date, {k}) over w as date_{h}"
                    for h, k in HORIZONS.items())


def _pct(later: str, base: str) -> str:
    return f"round(({later} - {base}) / {base} * 100, 4)"


def _returns(days_after: int) -> str:
    reach = days_after + 10
    cols = ", ".join(
        f"case when x.date_{h} < ev.event_date + {reach} then {_pct(f'x.close_{h}', 'x.close')} end as return_{h}"
        for h in HORIZON_ORDER
    )
    return f"""
  select ev.symbol, ev.quarter, ev.year, ev.event_date, {cols},
    case when x.prev_date >= ev.event_date - 5 then {_pct('x.close', 'x.prev_close')} end as return_earnings_day
  from ev
  join (select symbol, quarter, year, count(*) as n_bars,
               count(case when date >= event_date then 1 end) as n_after,
               min(case when date >= event_date then date end) as base_date
        from (select ev.*, b.date from ev join bars b on b.symbol = ev.symbol
              and b.date >= ev.event_date - 5 and b.date < ev.event_date + {reach}) g
        group by symbol, quarter, year) c
    on c.symbol = ev.symbol and c.quarter = ev.quarter and c.year = ev.year
  join leads x on x.symbol = ev.symbol and x.date = c.base_date
  where c.n_bars >= 5 and c.n_after >= 2"""


_SYMBOL = "'S' || cast({} as varchar)"

TABLES: dict[str, tuple[list[str], str]] = {
    "bars": ([], f"""
  select {_SYMBOL.format('l_suppkey')} as symbol, cast(l_shipdate as date) as date,
         {wh.CLOSE} as close
  from lineitem group by 1, 2"""),
    "ev": ([], f"""
  select {_SYMBOL.format('s_suppkey')} as symbol, cast(qi % 4 + 1 as integer) as quarter,
         cast(qi // 4 as integer) as year,
         make_date(cast(qi // 4 as integer), cast((qi % 4) * 3 + 2 as integer), 15) as event_date
  from supplier, (
    select year(d) * 4 + quarter(d) - 1 as qi
    from (select cast(unnest(generate_series(date '1900-02-15', date '2199-11-15', interval 3 month)) as date) as d) c,
         (select min(cast(l_shipdate as date)) as low, max(cast(l_shipdate as date)) as high from lineitem) s
    where d > low and d <= high + 90) q"""),
    "leads": (["bars"], f"""
  select b.symbol, b.date, b.close, lag(b.close) over w as prev_close, lag(b.date) over w as prev_date, {_HIDDEN}
  from bars b window w as (partition by symbol order by date)"""),
    "returns": (["bars", "ev", "leads"], _returns(wh.DAYS_AFTER)),
    "returns_short": (["bars", "ev", "leads"], _returns(30)),
    "lines": (["ev"], """
  select ev.symbol, ev.quarter, ev.year, l.*
  from lineitem l join ev on ev.symbol = 'S' || cast(l.l_suppkey as varchar)
   and cast(l.l_shipdate as date) >= ev.event_date - 90 and cast(l.l_shipdate as date) < ev.event_date"""),
    "scores": (["lines"], "\n  select symbol, quarter, year, n, "
               + ", ".join(f"{wh.ratio_score(*wh.FEATURE_RATIOS[f])} as {f}" for f in KNOWN_FEATURES)
               + "\n  from (select symbol, quarter, year, "
               + ", ".join(f"{e} as {k}" for k, e in wh.LINE_SUMS.items())
               + " from lines group by 1, 2, 3) s"),
    "dataset": (["returns", "scores"], "\n  select r.symbol, r.quarter, r.year, "
                "strftime(r.event_date, '%Y-%m-%d') as earnings_date, s.n, "
                + ", ".join(f"s.{f} as feat_{f}" for f in KNOWN_FEATURES) + ", "
                + ", ".join(f"r.return_{h}" for h in HORIZON_ORDER)
                + ", r.return_earnings_day\n  from returns r join scores s using (symbol, quarter, year)"),
    "order_sums": (["lines"], "\n  select symbol, quarter, year, "
                   + ", ".join(f"{e} as {k}" for k, e in wh.ORDER_SUMS.items())
                   + " from lines join orders on o_orderkey = l_orderkey group by 1, 2, 3"),
    "market": (["returns"], f"""
  select event_date, {wh.MARKET_MEAN.format('return_5D')} as spxReturn7d,
         {wh.MARKET_MEAN.format('return_21D')} as spxReturn30d
  from returns group by 1"""),
    "filings": (["order_sums", "returns", "market"], "\n  select lower(o.symbol) as ticker, "
                "strftime(r.event_date + shift, '%Y-%m-%d') as filingDate, "
                + ", ".join(f"{e} as {c}" for c, e in wh.FILING_EXPRS.items())
                + """, m.spxReturn7d, m.spxReturn30d, 10e0 + o.quarter + o.year % 5 as vixClose,
    r.return_5D as actual7dReturn, r.return_21D as actual30dReturn,
    round(r.return_5D - m.spxReturn7d, 4) as actual7dAlpha,
    round(r.return_21D - m.spxReturn30d, 4) as actual30dAlpha
  from order_sums o join returns r using (symbol, quarter, year) join market m on m.event_date = r.event_date
  join (select 0 as shift union all select 20) k on k.shift = 0 or (o.quarter = 2 and o.n % 4 = 0)"""),
    "transcripts": ([], """
  select doc_id, source as ticker, cast(doc_id % 4 + 1 as integer) as quarter,
         cast(2014 + (doc_id // 4) % 12 as integer) as year, text as transcript,
         case when doc_id % 7 <> 0 then cast(make_date(cast(2014 + (doc_id // 4) % 12 as integer),
              cast((doc_id % 4 + 1) * 3 - 1 as integer), 15) as varchar) || 'T16:30:00' end as earnings_date
  from documents"""),
    "actions": ([], """
  select 'S' || cast(o_custkey % (select count(*) from supplier) as varchar) as symbol,
         cast(o_orderdate as date) as activity_date, n_name as firm,
         case o_orderpriority when '1-URGENT' then 'upgrade' when '5-LOW' then 'downgrade' else 'maintain' end as action_type
  from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey"""),
}


def with_tables(names: list[str], extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause holding the named model tables and what they need, then ``extra``."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in TABLES[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} as ({TABLES[n][1]}\n)" for n in order]
    parts += [f"{n} as ({sql}\n)" for n, sql in (extra or {}).items()]
    return "with " + ",\n".join(parts) + "\n"


def sql(names: list[str], select: str, **extra: str) -> str:
    if not names and not extra:
        return select
    return with_tables(names, extra) + select
