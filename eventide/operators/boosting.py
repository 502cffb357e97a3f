"""Boosted regression trees of many training sets at once.

Walk-forward refits and time-ordered folds train on the first rows of one order, so they share these rows. Every round and level
is one pass over them that adds up the histograms of all fits, instead of a chain of jobs per fit: 300 rounds of depth three are
900 passes, however many fits there are. The trees are those of Spark ML's ``GBTRegressor`` (squared error, first tree at full
weight, the best reduction of variance over at most 128 bins), apart from which rows a round draws and from exact split points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators.ordering import POSITION, cumulative_counts
from eventide.operators.zoo import Design
from eventide.session import stage

BINS = 128
#: A node that is not split sends all rows to the left.
NO_SPLIT = 255
#: Rows per task at least (tasks at most ``WAVES`` per core, each sends one set of histograms), and per block at most.
TASK_ROWS, WAVES, BLOCK_ROWS = 50_000, 2, 250_000
#: Rounds after which margins are worked out from the rows and all trees again, so that lineage stays short and no folder is needed.
RESTART = 50


@dataclass(frozen=True)
class Fit:
    """Trained on the rows whose position is less than ``end``."""

    end: int
    maxIter: int = 20
    maxDepth: int = 5
    stepSize: float = 0.1
    subsamplingRate: float = 1.0
    minInstancesPerNode: int = 1


@dataclass
class Tree:
    """A complete binary tree: splits level by level, values of the leaves. Rows whose bin is at most ``bin`` go to the left."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        inner = 2**depth - 1
        return cls(np.zeros(inner, "int16"), np.full(inner, NO_SPLIT, "uint8"), np.zeros(inner + 1))

    def nodes(self, bins: np.ndarray, level: int) -> np.ndarray:
        """Place of every row among the nodes of a level; ``bins`` has a row per feature."""
        node = np.zeros(bins.shape[1], "int64")
        for k in range(level):
            right = np.zeros(bins.shape[1], bool)
            for i in range(2**k):
                at = 2**k - 1 + i
                if self.bin[at] != NO_SPLIT:
                    right |= (node == i) & (bins[self.feature[at]] > self.bin[at])
            node = 2 * node + right
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins, len(self.value).bit_length() - 1)]


@dataclass
class Block:
    """Some rows in order of position, their bins by training set, and the margin of every fit for its training rows."""

    position: np.ndarray
    y: np.ndarray
    bins: list[np.ndarray]
    margins: list[np.ndarray]


@dataclass
class Boosted:
    """Trees per fit, and split points per training set and feature."""

    fits: list[Fit]
    points: dict[int, list[np.ndarray]]
    trees: list[list[Tree]]


def split_points(rows: DataFrame, columns: list[str], ends: list[int], bins: int = BINS) -> dict[int, list[np.ndarray]]:
    """Per training set and column at most ``bins - 1`` points between neighbouring values, all of them or those nearest to even shares.

    What comes to the driver is as many numbers, whatever the rows.
    """
    first = sum((F.when(F.col(POSITION) >= e, 1).otherwise(0) for e in ends), F.lit(0))
    seen = rows.where(F.col(POSITION) < ends[-1]).select(first.alias("_from"), *columns)
    seen = seen.unpivot(["_from"], columns, "feature", "value").groupBy("_from", "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    of_sets = seen.select(F.explode(F.sequence("_from", F.lit(len(ends) - 1))).alias("set"), "feature", "value", "n")
    group = ["set", "feature"]
    counts = stage(cumulative_counts(of_sets, group, "value", {"cnt": F.sum("n")}), "counts")
    upto = F.col("cnt_before") + F.col("cnt")
    share = F.col("cnt_total") / F.lit(float(bins))
    sizes = counts.groupBy(*group).agg(F.count(F.lit(1)).alias("_values"))  # a row per training set and feature
    placed = counts.join(F.broadcast(sizes), group).withColumn("_upto", upto).where(F.col("_upto") < F.col("cnt_total"))
    nearest = F.greatest(F.lit(1.0), F.least(F.lit(bins - 1.0), F.round(F.col("_upto") / share)))
    placed = placed.withColumn("_k", F.when(F.col("_values") <= bins, F.col("_upto").cast("double")).otherwise(nearest))
    gap = F.when(F.col("_values") <= bins, F.lit(0.0)).otherwise(F.abs(F.col("_upto") - F.col("_k") * share))
    kept = placed.groupBy(*group, "_k").agg(F.min_by(F.struct("value", "_upto"), F.struct(gap, "value")).alias("p")).select(*group, "p.*")
    above = counts.select(*group, F.col("cnt_before").alias("_upto"), F.col("value").alias("next"))
    found = kept.join(above, [*group, "_upto"]).select(*group, ((F.col("value") + F.col("next")) / 2).alias("point")).collect()
    points = {e: [[] for _ in columns] for e in ends}
    for r in found:
        points[ends[r["set"]]][columns.index(r["feature"])].append(r["point"])
    return {e: [np.unique(p) for p in of_set] for e, of_set in points.items()}


def _binned(x: np.ndarray, points: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(p, x[:, j], side="left").astype("uint8") for j, p in enumerate(points)])


def _drawn(position: np.ndarray, number: int, share: float) -> np.ndarray:
    """Whether a round draws a row: by a hash of both, so it does not matter which task asks."""
    if share >= 1:
        return np.ones(len(position), bool)
    z = position.astype("uint64") * np.uint64(0x9E3779B97F4A7C15) + np.uint64((number + 43) * 0xD1342543DE82EF95 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31)) < np.uint64(int(share * 2**64))


def _blocks(design: Design, fits: list[Fit], points: dict[int, list[np.ndarray]]) -> RDD:
    """Training rows, dealt over the tasks by position, as blocks of arrays."""
    columns, last, ends = design.columns, max(f.end for f in fits), list(points)
    context = design.rows.sparkSession.sparkContext
    tasks = max(1, min(-(-last // TASK_ROWS), WAVES * context.defaultParallelism))
    dealt = design.rows.where(F.col(POSITION) < last).select(POSITION, "y", *columns).repartition(tasks, POSITION)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch.to_numpy(float))
            n += len(batch)
            if n >= BLOCK_ROWS:
                yield pd.DataFrame({"rows": [np.concatenate(waiting).tobytes()]})
                waiting, n = [], 0
        if n:
            yield pd.DataFrame({"rows": [np.concatenate(waiting).tobytes()]})

    def block(row) -> Block:
        rows = np.frombuffer(row["rows"]).reshape(-1, 2 + len(columns))
        rows = rows[np.argsort(rows[:, 0])]
        position = rows[:, 0].astype("int64")
        upto = {e: np.searchsorted(position, e) for e in ends}
        return Block(position, rows[:, 1].copy(), [_binned(rows[: upto[e], 2:], points[e]) for e in ends], [np.zeros(upto[f.end]) for f in fits])

    return dealt.mapInPandas(packed, "rows binary").rdd.map(block)


def _advanced(state: RDD, fits: list[Fit], ends: list[int], rounds: list[tuple[int, list[Tree | None]]]) -> RDD:
    """Margins after more rounds; the first tree counts whole."""

    def advance(b: Block) -> Block:
        margins = [m.copy() for m in b.margins]
        for number, trees in rounds:
            for k, (fit, tree) in enumerate(zip(fits, trees)):
                if tree is not None and len(margins[k]):
                    margins[k] += (fit.stepSize if number else 1.0) * tree.predict(b.bins[ends.index(fit.end)])
        return Block(b.position, b.y, b.bins, margins)

    return state.map(advance)


def _histograms(state: RDD, fits: list[Fit], points: dict[int, list[np.ndarray]], trees: list[Tree | None], number: int, level: int) -> list:
    """Per fit the rows and sums of what a round fits, by feature, node of a level and bin: one set of them per task is added up here."""
    ends = list(points)
    widths = [max(map(len, points[f.end])) + 1 for f in fits]

    def tally(blocks: Iterator[Block]) -> Iterator[list]:
        total: list = [None] * len(fits)
        for b in blocks:
            drawn = {f.subsamplingRate: _drawn(b.position, number, f.subsamplingRate) for f in fits}
            for k, (fit, tree) in enumerate(zip(fits, trees)):
                n = len(b.margins[k])
                if tree is None or n == 0:
                    continue
                bins, cells, width = b.bins[ends.index(fit.end)], 2**level * widths[k], widths[k]
                target = 2 * (b.y[:n] - b.margins[k]) if number else b.y[:n]
                # rows that are not drawn are counted behind the last node
                start = np.where(drawn[fit.subsamplingRate][:n], tree.nodes(bins, level) * width, cells)
                if total[k] is None:
                    total[k] = (np.zeros((len(bins), cells)), np.zeros((len(bins), cells)))
                for j, own in enumerate(bins):
                    at = start + own
                    total[k][0][j] += np.bincount(at, minlength=cells)[:cells]
                    total[k][1][j] += np.bincount(at, target, cells)[:cells]
        yield total

    added: list = [None] * len(fits)
    for part in state.mapPartitions(tally).collect():
        for k, found in enumerate(part):
            if found is not None:
                added[k] = found if added[k] is None else (added[k][0] + found[0], added[k][1] + found[1])
    return [a and tuple(x.reshape(len(x), 2**level, -1) for x in a) for a in added]


def _split(tree: Tree, fit: Fit, counts: np.ndarray, sums: np.ndarray, level: int, alive: set[int]) -> set[int]:
    """Split the nodes of a level that are alive, where that reduces the variance; the children that are."""
    left_n, left_s = counts.cumsum(2), sums.cumsum(2)
    n, s = left_n[:, :, -1:], left_s[:, :, -1:]
    right_n, right_s = n - left_n, s - left_s
    allowed = (left_n >= fit.minInstancesPerNode) & (right_n >= fit.minInstancesPerNode) & (left_n > 0) & (right_n > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(allowed, left_s**2 / left_n + right_s**2 / right_n - s**2 / n, 0.0)
    children, leaves = set(), 2 ** (fit.maxDepth - level)
    for i in alive:
        j, b = np.unravel_index(np.argmax(gain[:, i]), gain[:, i].shape)
        if gain[j, i, b] > 0:
            tree.feature[2**level - 1 + i], tree.bin[2**level - 1 + i] = j, b
            tree.value[i * leaves] = left_s[j, i, b] / left_n[j, i, b]
            tree.value[i * leaves + leaves // 2] = right_s[j, i, b] / right_n[j, i, b]
            children |= {2 * i, 2 * i + 1}
        elif level == 0 and n[0, i, 0]:
            tree.value[0] = s[0, i, 0] / n[0, i, 0]
    return children


def fit_boosted(design: Design, fits: list[Fit]) -> Boosted:
    """All fits side by side: a pass over the rows per round and level, for all of them."""
    points = split_points(design.rows, design.columns, sorted({f.end for f in fits}))
    ends = list(points)
    blocks = _blocks(design, fits, points).persist(StorageLevel.MEMORY_AND_DISK)
    state, done = blocks, []
    for number in range(max(f.maxIter for f in fits)):
        if number:
            since = done if number % RESTART == 0 else done[-1:]
            before, state = state, _advanced(blocks if number % RESTART == 0 else state, fits, ends, since).persist(StorageLevel.MEMORY_AND_DISK)
        trees = [Tree.empty(f.maxDepth) if number < f.maxIter else None for f in fits]
        alive = [{0} for _ in fits]
        for level in range(max(f.maxDepth for f in fits)):
            growing = [t if t is not None and alive[k] and level < fits[k].maxDepth else None for k, t in enumerate(trees)]
            if not any(t is not None for t in growing):
                break
            for k, found in enumerate(_histograms(state, fits, points, growing, number, level)):
                if found is not None:
                    alive[k] = _split(trees[k], fits[k], *found, level, alive[k])
            if number and level == 0 and before is not blocks:
                before.unpersist()
        done.append((number, trees))
    for kept in {state, blocks}:
        kept.unpersist()
    return Boosted(fits, points, [[trees[k] for _, trees in done if trees[k] is not None] for k in range(len(fits))])


def predict_boosted(design: Design, model: Boosted, tests: list[tuple[int, int, int]], keep: list[str]) -> DataFrame:
    """(keep..., fit, predicted) of the rows between the positions of each (fit, first, end), in one pass over the rows."""
    columns = design.columns
    types = {f.name: f.dataType.simpleString() for f in design.rows.select(*keep).schema}
    schema = ", ".join([*[f"`{c}` {t}" for c, t in types.items()], "fit int", "predicted double"])

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            position = batch[POSITION].to_numpy()
            for k, first, end in tests:
                rows = batch[(position >= first) & (position < end)]
                if len(rows):
                    fit = model.fits[k]
                    bins = _binned(rows[columns].to_numpy(float), model.points[fit.end])
                    total = sum((fit.stepSize if i else 1.0) * t.predict(bins) for i, t in enumerate(model.trees[k]))
                    yield rows[keep].assign(fit=k, predicted=total)

    inside = [(F.col(POSITION) >= first) & (F.col(POSITION) < end) for _, first, end in tests]
    rows = design.rows.where(F.lit(False) if not inside else F.exists(F.array(*inside), lambda x: x))
    return rows.select(*dict.fromkeys([*keep, POSITION, *columns])).mapInPandas(predict, schema)
