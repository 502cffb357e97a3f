"""Toxicity by a string-kernel support vector machine with Nyström landmarks.

The kernel compares two words by their common subsequences of three letters that span at most ``SPAN`` letters, each
occurrence weighted by ``DECAY`` to its span, normalised to length one. So an insult stays close to itself with letters
put in, left out or appended. Words are white-space tokens reduced to their letters; single letters in a row are read as
one word as well.

Training reads labelled sentences: every sentence of a clean document is negative, and of a toxic document those
sentences are positive that have a word which is significantly more frequent in toxic documents (and whose beginning is
hardly known from clean ones), and from the second fit on also a document's strongest sentence, if the last fit finds it toxic (multiple-instance rounds). A
sentence counts by its strongest word, and a document by its strongest sentence. The kernel against the landmarks, whitened
(Nyström), feeds a linear machine with squared hinge loss. As the machine is linear in the kernel, it folds into one weight
per letter triple, which is all that scoring needs. A logistic curve, fitted on
sample documents that the machine didn't see, turns the strongest word's margin into the score.

The sample that one task fits on, so that the driver only gets the weights, is bounded: ``SAMPLE`` documents of each label of at most ``SAMPLE_CHARS`` characters,
taken by hash from labelled rows that training may use. Every document is scored over its whole text.

Cases: null and empty texts get the lowest score; without labels of both classes every score is 0; conflicting labels of
one document count as toxic; repeated rows get equal scores; columns other than the key and the text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.batches import map_texts, process_memory, slices

SLICE_BYTES = 1_000_000
KNOWN_WORDS = 300_000
#: Words whose margins are worked out at a time.
MARGIN_WORDS = 20_000
SPAN, DECAY = 8, 0.5
SAMPLE, SAMPLE_CHARS = 1_500, 20_000
LANDMARKS, NEGATIVES, ROUNDS, PENALTY = 192, 24_000, 4, 1e-3
STEM = 5
THRESHOLD = 0.7
#: Words whose score can't exceed this aren't worked out exactly; it is also the lowest score.
LOWEST = 0.01

_SENTENCE = re.compile(r"[.!?…\n]+")
_SPACED = re.compile(r"(?<!\S)\w(?: \w){2,}(?!\S)")
_PAIRS = [(a, b, DECAY ** (b + 1)) for b in range(2, SPAN) for a in range(1, b)]
_SYMBOLS = 64


def letters(token: str) -> str:
    return token if token.isalpha() else "".join(c for c in token if c.isalpha())


def tokens(text: str) -> set[str]:
    """Distinct tokens of a text, and its rows of single characters as one token each."""
    found = set(text.lower().split())
    for m in _SPACED.finditer(text):
        found.add(m[0].replace(" ", "").lower())
    return found


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all letters in a row, and the word that each belongs to."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where((points >= 97) & (points <= 122), points - 96, 27 + points % 37)
    return codes, np.repeat(np.arange(len(words)), [len(w) for w in words])


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised features as (word, triple, value), sorted by word and triple."""
    codes, word = _flat(words)
    keys, values = [], []
    for a, b, weight in _PAIRS:
        if len(codes) > b:
            same = word[:-b] == word[b:]
            triple = (codes[:-b] * _SYMBOLS + codes[a : len(codes) - b + a]) * _SYMBOLS + codes[b:]
            keys.append((word[:-b] * _SYMBOLS**3 + triple)[same])
            values.append(np.full(int(same.sum()), weight))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    value = np.bincount(place, weights=np.concatenate(values))
    word, triple = np.divmod(key, _SYMBOLS**3)
    norm = np.sqrt(np.bincount(word, weights=value**2, minlength=len(words)))
    return word, triple, value / norm[word]


def kernel(words: list[str], landmarks: list[str], project: np.ndarray | None = None) -> np.ndarray:
    """Kernel of every word with every landmark, or its product with ``project`` and a column of ones."""
    at, triple, value = features(landmarks)
    used, place = np.unique(triple, return_inverse=True)
    dense = np.zeros((len(used), len(landmarks)))
    dense[place, at] = value
    out = np.ones((len(words), len(landmarks) if project is None else project.shape[1] + 1))
    for start in range(0, len(words), 250):  # a row of the size of the landmarks for each of their triples
        part = words[start : start + 250]
        word, triple, value = features(part)
        slot = np.minimum(np.searchsorted(used, triple), max(0, len(used) - 1))
        known = used[slot] == triple if len(used) else np.zeros(len(triple), bool)
        word, rows = word[known], dense[slot[known]] * value[known, None]
        found = np.zeros((len(part), len(landmarks)))
        if len(word):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            found[word[first]] = np.add.reduceat(rows, first, axis=0)
        out[start : start + len(part), : len(landmarks) if project is None else -1] = found if project is None else found @ project
    return out


class Model(NamedTuple):
    weights: np.ndarray  # by letter triple
    bias: float
    slope: float
    shift: float

    def lowest(self) -> float:
        """The margin whose score is LOWEST."""
        return (np.log(LOWEST / (1 - LOWEST)) - self.shift) / self.slope

    def margins(self, words: list[str]) -> np.ndarray:
        """Margin of every word, at least ``lowest()``."""
        if len(words) > MARGIN_WORDS:
            return np.concatenate([self.margins(words[i : i + MARGIN_WORDS]) for i in range(0, len(words), MARGIN_WORDS)])
        floor = self.lowest()
        out = np.full(len(words), floor)
        codes, word = _flat(words)
        if len(codes) < 3:
            return out
        value, squares = np.zeros(len(codes)), np.zeros(len(codes))
        for a, b, weight in _PAIRS:
            if len(codes) > b:
                same = word[:-b] == word[b:]
                triple = (codes[:-b] * _SYMBOLS + codes[a : len(codes) - b + a]) * _SYMBOLS + codes[b:]
                value[:-b] += self.weights[triple] * same * weight
                squares[:-b] += same * weight**2
        total = np.bincount(word, weights=value, minlength=len(words))
        # a triple that occurs twice only makes the norm larger than this, and a positive margin smaller
        least = np.sqrt(np.bincount(word, weights=squares, minlength=len(words)))
        at_most = np.where(least > 0, total / np.maximum(least, 1e-12), 0) + self.bias
        open_ = np.flatnonzero((at_most > floor) & (least > 0) & (total > 0))
        for start in range(0, len(open_), 4_000):
            part = open_[start : start + 4_000]
            w, triple, v = features([words[i] for i in part])
            exact = np.bincount(w, weights=self.weights[triple] * v, minlength=len(part)) + self.bias
            out[part] = np.maximum(exact, floor)
        return out

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def _evidence(toxic: int, clean: int, share: float) -> float:
    """Likelihood ratio statistic of a word's document counts against the share of toxic documents."""
    n = toxic + clean
    return 2 * sum(k * np.log(k / (n * q)) for k, q in ((toxic, share), (clean, 1 - share)) if k)


def _machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, both classes weighing the same, by Newton steps; last column: ones."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    ridge = np.diag(np.r_[np.full(x.shape[1] - 1, PENALTY / 10), 1e-8])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        active = y * (x @ w) < 1
        weighted = x * (share * active)[:, None]
        new = np.linalg.solve(ridge + weighted.T @ x, weighted.T @ y)
        done = np.abs(new - w).max() < 1e-9
        w = new
        if done:
            break
    return w[:-1], float(w[-1])


def _curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with targets drawn in from 0 and 1 (Platt)."""
    pos, neg = (label > 0).sum(), (label <= 0).sum()
    target = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(label > 0, 0.5 / max(1, pos), 0.5 / max(1, neg))
    x, w = np.c_[margin, np.ones(len(margin))], np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (p - target)) + 1e-6 * w)
        w = w - step * min(1.0, 2 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def fit(texts: list[str], labels: list[int]) -> Model | None:
    """Model of a sample in a fixed order; None without documents of both labels."""
    if len(set(labels)) < 2:
        return None
    label = np.where(np.array(labels) > 0, 1, -1)
    docs = []  # sentences of each document as sets of words
    for text in texts:
        sentences = [{w for t in tokens(s) if len(w := letters(t)) >= 3} for s in _SENTENCE.split(text)]
        docs.append([s for s in sentences if s] or [set()])
    turn = np.zeros(len(label), int)
    for y in (1, -1):
        turn[label == y] = np.arange((label == y).sum()) % 4
    learn = turn != 3  # the others calibrate
    if len(set(label[learn])) < 2 or len(set(label[~learn])) < 2:
        learn = np.ones(len(label), bool)
    toxic, clean, toxic_stems, clean_stems = Counter(), Counter(), Counter(), Counter()
    for d, y, use in zip(docs, label, learn):
        if use:
            words = set().union(*d)
            (toxic if y > 0 else clean).update(words)
            (toxic_stems if y > 0 else clean_stems).update({w[:STEM] for w in words})
    n_toxic, n_clean = (label[learn] > 0).sum(), (label[learn] < 0).sum()
    least = 2 * np.log(100 * max(1, len(toxic)))  # one word in a hundred fits passes by chance
    # significant words whose beginning is hardly known from clean text
    significant = {
        w for w, n in toxic.items()
        if n > 9 * clean[w] and toxic_stems[w[:STEM]] > 12 * clean_stems[w[:STEM]] and _evidence(n, clean[w], n_toxic / (n_toxic + n_clean)) > least
    }
    suspicion = {w: (w in significant, np.log((n + 0.5) / n_toxic) - np.log((clean[w] + 0.5) / n_clean)) for w, n in toxic.items()}
    negative = sorted(clean, key=lambda w: (-clean[w], w))
    sampled = negative[: NEGATIVES // 4] + negative[NEGATIVES // 4 :: max(1, len(negative) // (3 * NEGATIVES // 4))]
    hard: list[str] = []
    model = None
    for step in range(ROUNDS):
        chosen = set()
        for d, y, use in zip(docs, label, learn):
            if use and y > 0:
                strong = [max(s, key=lambda w: (suspicion[w], w)) for s in d if s]
                best = max(strong, key=lambda w: (suspicion[w], w), default=None)
                chosen.update(w for w in strong if w in significant)
                # a document's strongest word alone says little, unless the last fit finds it like known ones
                if best is not None and clean[best] == 0 and (suspicion[best][1] > 0 if step else not significant):
                    chosen.add(best)
        positive = sorted(chosen, key=lambda w: (-toxic[w], w))
        if not positive:
            return None
        rest = sorted(set(sampled) | set(hard) - set(positive))
        marks = _landmarks(positive, hard or sampled)
        values, vectors = np.linalg.eigh(kernel(marks, marks))
        keep = values > 1e-6 * values.max()
        whiten = vectors[:, keep] / np.sqrt(values[keep])
        words = positive + rest
        w, bias = _machine(kernel(words, marks, whiten), np.r_[np.ones(len(positive)), -np.ones(len(rest))])
        at, triple, value = features(marks)
        weights = np.bincount(triple, weights=(whiten @ w)[at] * value, minlength=_SYMBOLS**3)
        model = Model(weights, bias, 1.0, 60.0)  # no floor while it is fitted
        every = sorted(set(toxic) | set(clean))
        margin = dict(zip(every, model.margins(every).tolist()))
        suspicion = {x: (x in significant, margin[x]) for x in toxic}
        hard = sorted(clean, key=lambda x: (-margin[x], x))[: NEGATIVES // 4]
    test = ~learn if (~learn).any() else learn
    every = sorted(set().union(*(s for d, t in zip(docs, test) if t for s in d)))
    margin = dict(zip(every, np.maximum(model.margins(every), -3.0)))
    found = np.array([max((margin[w] for s in d for w in s), default=-3.0) for d, t in zip(docs, test) if t])
    slope, shift = _curve(found, label[test])
    return model._replace(weights=model.weights.astype(np.float32), slope=slope, shift=shift)


def _landmarks(positive: list[str], negative: list[str]) -> list[str]:
    """Frequent positive words that differ from each other, then words of clean text."""
    marks: list[str] = []
    for word in positive:
        if len(marks) < 2 * LANDMARKS // 3 and (not marks or kernel([word], marks).max() < 0.9):
            marks.append(word)
    return marks + [w for w in negative if w not in marks][: LANDMARKS - len(marks)]


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` documents of each label; rows that are held out are never read for it."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    texts = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where(F.length("text").between(1, SAMPLE_CHARS))
    there = known.join(texts.select("key").distinct(), "key", "left_semi")
    by_hash = [F.xxhash64("key"), F.col("key")]
    ids = there.where(F.col("label") == 1).orderBy(*by_hash).limit(sample).unionByName(there.where(F.col("label") == 0).orderBy(*by_hash).limit(sample))
    rows = texts.join(F.broadcast(ids), "key").groupBy("key", "label").agg(F.min("text").alias("text"))  # at most 2 * sample rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [r for batch in batches for r in batch.to_pylist()]
        known.sort(key=lambda r: (-r["label"], str(r["key"])))
        model = fit([r["text"] for r in known], [r["label"] for r in known])
        if model:
            numbers = [pa.array([float(x)]) for x in model[1:]]
            yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), *numbers], names=["weights", "bias", "slope", "shift"])

    found = map_texts(rows.repartition(1), run, "weights binary, bias double, slope double, shift double").collect()
    return Model(np.frombuffer(bytes(found[0]["weights"]), np.float32), *found[0][1:]) if found else None


class _Known(dict):
    """Margins of the tokens that a process has met lately under one model."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.floor = model, model.lowest()

    def learn(self, found: set[str]) -> None:
        todo = sorted(t for t in found if t not in self)
        if len(self) + len(todo) > KNOWN_WORDS:
            self.clear()
            todo = sorted(found)
        words = [letters(t) for t in todo]
        long = [i for i, w in enumerate(words) if len(w) >= 3]
        self.update(zip(todo, [self.floor] * len(todo)))
        self.update(zip([todo[i] for i in long], self.model.margins([words[i] for i in long]).tolist() if long else []))


def known_words(model: Model, mark: bytes) -> _Known:
    """The process's memory for a model, used by all its tasks."""
    return process_memory(("toxicity", mark), lambda: _Known(model))


def score(documents: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns: the key, ``held_out``, ``score`` and ``predicted``."""
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    scored = map_texts(rows, _scorer(model, 1, lambda part, values: pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.float64())], names=["key", "score"])), f"key {kind}, score double")
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def remove_toxic(documents: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``documents`` without the rows whose score reaches the threshold; nothing is shuffled."""
    at = documents.columns.index(text)
    return map_texts(documents, _scorer(model, at, lambda part, values: part.filter(pa.array(values < THRESHOLD))), documents.schema)


def _scorer(model: Model | None, at: int, use):
    """A task that hands every slice and the scores of its texts to ``use``."""
    mark = hashlib.sha256(model.weights.tobytes() + repr(model[1:]).encode()).digest() if model else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_words(model, mark) if model else None
        for part in slices(batches, at, SLICE_BYTES):
            if known is None:
                values = np.zeros(part.num_rows)
            else:
                found = [tokens(t) if t else set() for t in part.column(at).to_pylist()]
                known.learn(set().union(*found))
                margin = np.array([max(map(known.__getitem__, f), default=known.floor) for f in found])
                values = np.round(model.score(margin), 6)
            yield use(part, values)

    return run
