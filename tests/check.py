"""Run registered queries against their SQL: python tests/check.py SF_DIR [name-part ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

import compare  # noqa: E402


def session(cpus: str = "8", memory: str = "8g"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    import __spark_entry__ as entry

    sf_dir, parts = sys.argv[1], sys.argv[2:]
    exact = {p[1:] for p in parts if p.startswith("=")}
    parts = [p for p in parts if not p.startswith("=")]
    spark, con = session(), compare.connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if (parts or exact) and name not in exact and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem, n = compare.compare(con, df, oracles[name])
            else:
                n = len(df.collect())
                problem = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        kind = "sql " if name in oracles else "rows"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {name:32} {n:7} rows {time.time() - t:6.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
