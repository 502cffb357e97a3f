"""Staged tables: what is left behind of their making."""

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from eventide import session


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_") and n.endswith(".data")}


def counted(spark, n):
    return spark.range(10_000).groupBy((F.col("id") % n).alias("k")).count().join(spark.range(n).withColumnRenamed("id", "k").hint("merge"), "k")


def test_stage_leaves_no_shuffle_files(spark):
    """They stayed until the driver collected its garbage, so that a long run held all it had ever shuffled."""
    before, setting = shuffle_files(spark), spark.conf.get(session._CLEANUP, None)
    rows = counted(spark, 70)
    staged = session.stage(rows, "counts")
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(session._CLEANUP, None) == setting
    assert sorted(map(tuple, staged.collect())) == sorted(map(tuple, rows.collect())) == sorted(map(tuple, rows.collect()))


def test_stage_side_by_side_keeps_the_setting(spark):
    setting = spark.conf.get(session._CLEANUP, None)
    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(lambda n: session.stage(counted(spark, n), "counts").count(), range(20, 32)))
    assert found == list(range(20, 32)) and spark.conf.get(session._CLEANUP, None) == setting
