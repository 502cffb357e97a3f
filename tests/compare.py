"""Compare a Spark result with a DuckDB result: same columns, same multiset of rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, int):
        return v
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plains = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(plains, key=lambda r: (repr([v for v in r if not isinstance(v, float)]), repr(r)))


def same(a, b, places):
    """Equal, or (with ``places``) apart by one unit of the last rounded place.

    A mean of four-place numbers often lies exactly between two four-place results; then the order
    of summation decides which one it is rounded to.
    """
    if a == b:
        return True
    if places is None or not (isinstance(a, float) and isinstance(b, float)):
        return False
    return abs(a - b) <= 1.01 * 10**-places and round(a, places) == a and round(b, places) == b


def compare(con, df, sql, places=None):
    """(problem or None, number of rows); exact unless ``places`` allows a last-place difference."""
    cur = con.execute(sql)
    oracle_cols = [d[0] for d in cur.description]
    want = rows(oracle_cols, cur.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(oracle_cols):
        return f"columns {sorted(df.columns)} != {sorted(oracle_cols)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if not all(same(a, b, places) for a, b in zip(g, w))]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {bad[0][0]} != {bad[0][1]}", len(got)
    return None, len(got)
