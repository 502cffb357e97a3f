"""Sums of products per block: everything a linear model needs, in one pass over the data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Beyond this many sums, compiling them costs more than partial Gram matrices on Arrow batches.
MAX_BUILTIN_PRODUCTS = 50


def sum_products(
    df: DataFrame, block: str, columns: list[str], pairs: list[tuple[int, int]]
) -> DataFrame:
    """(block, i, j, n, s): the sum of ``columns[i] * columns[j]`` and the complete-pair count.

    Both ways combine map-side, so what is shuffled is one row per task and block (or per task,
    block and pair), whatever the size of a block. NaN is a missing value like NULL, in both ways.
    """
    df = df.select(block, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    if len(pairs) <= MAX_BUILTIN_PRODUCTS:
        products = [F.col(columns[i]) * F.col(columns[j]) for i, j in pairs]
        wide = df.groupBy(block).agg(
            F.array(*[F.coalesce(F.sum(p), F.lit(0.0)) for p in products]).alias("s"),
            F.array(*[F.count(p) for p in products]).alias("n"),
        )
        ids = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])
        return wide.select(
            block, F.explode(F.arrays_zip(ids.alias("ij"), F.col("s"), F.col("n"))).alias("z")
        ).select(block, "z.ij.i", "z.ij.j", "z.n", "z.s")

    left = np.array([i for i, _ in pairs])
    right = np.array([j for _, j in pairs])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[object, list[np.ndarray]] = {}
        for batch in batches:
            for key, rows in batch.groupby(block, sort=False):
                x = rows[columns].to_numpy(dtype=float)
                there = ~np.isnan(x)
                x = np.where(there, x, 0.0)
                gram, seen = x.T @ x, there.T.astype(float) @ there
                if key in sums:
                    sums[key][0] += gram
                    sums[key][1] += seen
                else:
                    sums[key] = [gram, seen]
        for key, (gram, seen) in sums.items():
            yield pd.DataFrame({block: key, "i": left, "j": right,
                                "n": seen[left, right].astype("int64"), "s": gram[left, right]})

    schema = f"{block} {df.schema[block].dataType.simpleString()}, i int, j int, n bigint, s double"
    parts = df.select(block, *columns).mapInPandas(partial, schema)
    return parts.groupBy(block, "i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def moment_blocks(df: DataFrame, block: str, features: list[str], target: str) -> DataFrame:
    """(block, i, j, n, s) over [1, features..., target]: counts, sums, squares and products.

    Index 0 is the constant 1, so ``(0, 0)`` is the row count and ``(0, j)`` a plain sum.
    """
    names = ["_one", *features, target]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    return sum_products(df.withColumn("_one", F.lit(1.0)), block, names, pairs)


def gram_matrices(moments: DataFrame, block: str, size: int) -> dict[int, np.ndarray]:
    """Collect moment rows (one small matrix per fold) as symmetric matrices keyed by block."""
    out: dict[int, np.ndarray] = {}
    for row in moments.collect():
        m = out.setdefault(int(row[block]), np.zeros((size, size)))
        m[row["i"], row["j"]] = m[row["j"], row["i"]] = row["s"]
    return out
