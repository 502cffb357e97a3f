"""Quality by a regularised quadratic discriminant over transformed document statistics.

A text gives ``COUNTS``: words, code points, kinds of characters, lines, and what repeats. Counts become features by shares
in logarithms, drawn towards the share in all labelled texts by as much as ``PRIOR`` further units would, so that a short text
is an ordinary one and not an extreme one. Each class is a normal distribution of the features, standardised over both
classes. Its covariance is shrunk twice: towards the covariance within both classes, and towards its own mean variance on the
diagonal. How much is chosen from ``SHRINKAGE`` by the log loss on a part of the labelled rows (by hash of the key)
that the covariances don't use; the same part fits the logistic curve that turns the difference of the two log densities
into the score. A log density is a Mahalanobis distance and a determinant, both from the covariance's Cholesky factor,
which is worked out once and kept in the model.

Texts are read once, for their counts. Means and covariances are sums over all labelled rows; the choice and the curve
read numbers of rows per setting, label and bin of the difference. The driver only holds the sums of a class and these
histograms, whose size the parameters fix.

Cases: null and empty texts have counts of zero and get a score like any other; without labelled rows of both classes all
scores are 0.5; conflicting labels of one document count as 0, null labels and rows with a null key aren't learnt from
(the latter are scored, and not held out); repeated rows get equal scores; columns other than the key and the text are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.batches import slices
from eventide.operators.moments import sum_products
from eventide.session import stage

SLICE_BYTES = 4_000_000
COUNTS = ("words", "points", "letters", "upper", "digits", "marks", "symbols", "others", "lines", "repeated_lines", "distinct_words",
          "doubled_words", "short_words", "word_points", "squared_points")
#: Features as logarithms of shares: a count, and what it is a share of.
SHARES = (("upper", "letters"), ("digits", "points"), ("marks", "words"), ("symbols", "words"), ("others", "words"), ("repeated_lines", "lines"),
          ("doubled_words", "words"), ("distinct_words", "words"), ("short_words", "words"), ("word_points", "words"),
          ("squared_points", "word_points"), ("lines", "words"))
FEATURES = ("log_words", *(f"{a}_of_{b}" for a, b in SHARES))
PRIOR = 20.0
#: (towards the covariance within both classes, towards the diagonal)
SHRINKAGE = tuple((a, b) for a in (0.02, 0.1, 0.3, 0.6) for b in (0.001, 0.02, 0.1))
BINS, WIDEST = 400, 1e4
FOLDS = 4
THRESHOLD = 0.3
HELD_OUT = 5

_KIND = np.full(256, 2, np.int8)  # 0 white space, 1 continuation byte, 2 letter, 3 upper case, 4 digit, 5 mark, 6 symbol, 7 other
_KIND[:128] = 7
_KIND[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 0
_KIND[128:192] = 1
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 2, 3, 4
_KIND[[ord(c) for c in ".!?"]] = 5
_KIND[[ord(c) for c in "#*$%&|<>@^~_=+\\{}[]/`"]] = 6


def counts(texts: list[str]) -> np.ndarray:
    """A row of ``COUNTS`` per text; kinds of bytes are counted for all texts at once."""
    raws = [t.encode() for t in texts]
    sizes = np.array([len(r) for r in raws], np.int64)
    out = np.zeros((len(texts), len(COUNTS)))
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    kind = _KIND[np.frombuffer(b"".join(raws), np.uint8)]
    first = (np.cumsum(sizes) - sizes)[full]
    summed = lambda x: np.add.reduceat(x, first, dtype=np.int64)
    per = [summed(kind == k) for k in range(8)]
    place = dict(zip(COUNTS, range(len(COUNTS))))
    out[full, place["points"]] = sizes[full] - per[1]
    out[full, place["letters"]] = per[2] + per[3]
    for k, name in ((3, "upper"), (4, "digits"), (5, "marks"), (6, "symbols"), (7, "others")):
        out[full, place[name]] = per[k]
    # words: code points between white space, within a text
    inside = (kind != 0).astype(np.int8)
    begins = inside.copy()
    begins[1:] &= 1 - inside[:-1]
    begins[first] = inside[first]
    start = np.flatnonzero(begins)
    if len(start):
        own = np.searchsorted(first, start, "right") - 1
        points = np.add.reduceat((kind > 1), start, dtype=np.int64)
        for name, value in (("words", None), ("short_words", points <= 3), ("word_points", points), ("squared_points", points * points)):
            out[full, place[name]] = np.bincount(own, weights=value, minlength=len(full))
    for i in full.tolist():
        words = texts[i].split()
        lines = [x for x in texts[i].split("\n") if x.strip()]
        out[i, place["lines"]], out[i, place["repeated_lines"]] = len(lines), len(lines) - len(set(lines))
        out[i, place["distinct_words"]], out[i, place["doubled_words"]] = len(set(words)), sum(map(eq, words, words[1:]))
    return out


def features(rows: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Features of rows of counts; ``shares`` has the expected share of each of ``SHARES``."""
    place = dict(zip(COUNTS, range(len(COUNTS))))
    out = np.empty((len(rows), len(FEATURES)))
    out[:, 0] = np.log1p(rows[:, place["words"]])
    for j, ((a, b), share) in enumerate(zip(SHARES, shares), 1):
        out[:, j] = np.log((rows[:, place[a]] + PRIOR * share) / (rows[:, place[b]] + PRIOR))
    return out


class Normal(NamedTuple):
    """A class: its mean, the inverse of its covariance's Cholesky factor, and the factor's log determinant."""

    mean: np.ndarray
    unfactor: np.ndarray
    log_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.unfactor.T
        return -0.5 * np.einsum("ij,ij->i", z, z) - self.log_det


class Model(NamedTuple):
    shares: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    classes: tuple[Normal, Normal]
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, rows: np.ndarray) -> np.ndarray:
        """Log density under label 1 minus that under label 0, of rows of counts."""
        x = (features(rows, self.shares) - self.center) / self.scale
        return np.clip(self.classes[1].log_density(x) - self.classes[0].log_density(x), -WIDEST, WIDEST)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * squeezed(self.difference(rows)) + self.shift, -40, 40)))


def squeezed(difference: np.ndarray) -> np.ndarray:
    """Differences on a scale on which far ones don't count by their distance."""
    return np.arcsinh(difference)


def shrunk(mean: np.ndarray, covariance: np.ndarray, within: np.ndarray, towards: float, diagonal: float) -> Normal:
    """A class by its covariance, the one within both classes, and how far to go towards that and towards the diagonal."""
    mixed = (1 - towards) * covariance + towards * within
    mixed = (1 - diagonal) * mixed + diagonal * (np.trace(mixed) / len(mixed)) * np.eye(len(mixed)) + 1e-9 * np.eye(len(mixed))
    factor = np.linalg.cholesky(mixed)
    return Normal(mean, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))


def curve(value: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> tuple[float, float, float]:
    """Slope and shift of a logistic curve through numbers of rows of both labels at some values, and the mean log loss."""
    n = ones + zeros
    target = (ones + 1e-3) / (n + 2e-3)
    x, w = np.c_[value, np.ones(len(value))], np.array([0.5, 0.0])
    loss = lambda w: float(np.sum(n * (np.logaddexp(0, x @ w) - target * (x @ w))) + 1e-3 * w[0] ** 2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (n * (p - target)) + np.array([2e-3 * w[0], 0])
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag([2e-3, 1e-9]), gradient)
        size, old = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > old:
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-8 or size <= 1e-6:
            break
    return max(float(w[0]), 1e-3), float(w[1]), loss(w) / max(1, n.sum())


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(HELD_OUT)) == 0, F.lit(False))


def statistics(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key and its text's ``COUNTS``."""
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE_BYTES):
            found = counts(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c.astype(np.int64)) for c in found.T)], names=["key", *COUNTS])

    return rows.mapInArrow(run, f"key {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS]).astype(float)


def _moments(known: DataFrame, shares: np.ndarray) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Number, mean and covariance of the features per label, from sums over all rows."""
    names = [f"x{i}" for i in range(len(FEATURES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(_matrix(batch), shares)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(np.ones(len(x))), *(pa.array(c) for c in x.T)], names=["label", "one", *names])

    wide = known.mapInArrow(run, "label int, one double, " + ", ".join(f"{c} double" for c in names))
    d = len(names)
    sums = {0: np.zeros((d + 1, d + 1)), 1: np.zeros((d + 1, d + 1))}
    pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    for r in sum_products(wide, "label", ["one", *names], pairs).collect():  # two labels times the pairs
        sums[r["label"]][r["i"], r["j"]] = sums[r["label"]][r["j"], r["i"]] = r["s"]
    out = {}
    for label, s in sums.items():
        if s[0, 0] > 0:
            mean = s[0, 1:] / s[0, 0]
            out[label] = (s[0, 0], mean, s[1:, 1:] / s[0, 0] - np.outer(mean, mean))
    return out


def _histograms(known: DataFrame, models: list[Model]) -> dict[int, np.ndarray]:
    """Per model, numbers of rows by label and bin of the squeezed difference."""
    edge = float(squeezed(np.array([WIDEST]))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch)
            for m, model in enumerate(models):
                at = (squeezed(model.difference(rows)) + edge) / (2 * edge) * BINS
                bins = np.clip(at.astype(np.int32), 0, BINS - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), m, np.int32)), batch.column("label"), pa.array(bins)], names=["model", "label", "bin"])

    found = {m: np.zeros((2, BINS)) for m in range(len(models))}
    counted = known.mapInArrow(run, "model int, label int, bin int").groupBy("model", "label", "bin").count()
    for r in counted.collect():  # settings times labels times bins
        found[r["model"]][r["label"], r["bin"]] = r["count"]
    return found


def train(counted: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Model | None:
    """Fit on all rows of ``statistics`` that have a label and aren't held out; None without both labels."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("key")).agg(F.min(label).cast("int").alias("label"))
    known = stage(counted.join(known, "key").withColumn("fold", F.pmod(F.xxhash64("key"), F.lit(FOLDS))), "labelled")
    totals = known.agg(*[F.sum(c).alias(c) for c in COUNTS]).first()
    shares = np.array([((totals[a] or 0) + 1) / ((totals[b] or 0) + 2) for a, b in SHARES])
    fit, judge = known.where(f"fold < {FOLDS - 1}"), known.where(f"fold = {FOLDS - 1}")
    moments = _moments(fit, shares)
    if len(moments) < 2:
        fit = judge = known  # too few rows to put some aside
        moments = _moments(fit, shares)
    if len(moments) < 2:
        return None
    n = {k: m[0] for k, m in moments.items()}
    center = sum(n[k] * moments[k][1] for k in n) / sum(n.values())
    spread = sum(n[k] * (np.diag(moments[k][2]) + (moments[k][1] - center) ** 2) for k in n) / sum(n.values())
    scale = np.sqrt(np.maximum(spread, 1e-6))
    mean = {k: (moments[k][1] - center) / scale for k in n}
    covariance = {k: moments[k][2] / np.outer(scale, scale) for k in n}
    within = 0.5 * (covariance[0] + covariance[1])
    models = [Model(shares, center, scale, tuple(shrunk(mean[k], covariance[k], within, a, b) for k in (0, 1))) for a, b in SHRINKAGE]
    edge = float(squeezed(np.array([WIDEST]))[0])
    value = ((np.arange(BINS) + 0.5) / BINS * 2 - 1) * edge
    best = (math.inf, None)
    for m, histogram in _histograms(judge, models).items():
        slope, shift, loss = curve(value, histogram[1], histogram[0])
        if loss < best[0]:
            best = loss, models[m]._replace(slope=slope, shift=shift)
    return best[1]


def score(counted: DataFrame, model: Model | None, key: str = "doc_id") -> DataFrame:
    """Columns: the key, ``held_out``, ``score`` and ``predicted``."""
    kind = counted.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.full(batch.num_rows, 0.5) if model is None else np.round(model.score(_matrix(batch)), 6)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(values)], names=["key", "score"])

    scored = counted.mapInArrow(run, f"key {kind}, score double")
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
