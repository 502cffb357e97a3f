"""Benchmark decontamination by the q-gram lemma with verification by banded alignment.

Texts and items are compared as UTF-8 bytes, A-Z lower-cased and white space as blanks. An item of ``m`` bytes may differ
by ``k = EDITS * m`` edits. A place within that budget shares at least ``m - q + 1 - k * q`` q-grams with the item, on
diagonals (place in the text minus place in the item) that differ by at most ``k``. So hits are counted in bands of
``2 * (k + 1)`` diagonals that overlap by half, one of which holds them all; bands with enough hits are aligned, in the
band and ``k`` diagonals to either side, and the places within the budget are reported.

Items are handled in blocks of ``BLOCK_BYTES`` of text (one block unless the benchmark is larger), each a pass over the
documents; only a block's index is sent to the tasks. Texts are searched whole, long ones in pieces that overlap by more
than the longest item with its edits.

Cases: null and empty texts and items have no places; items of fewer than ``MIN_BYTES`` are no passages and aren't searched;
equal items are reported each; a text with several places reports each that doesn't overlap a better one of the same
item; repeated rows give repeated results; ``decontaminate`` passes all columns on, ``occurrences`` reads key and text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from eventide.llm.batches import map_texts, slices

EDITS = 0.1
BLOCK_BYTES, MIN_BYTES = 4_000_000, 16
SLICE_BYTES = PIECE = 2_000_000
#: q for long and short items; short ones would need less than one common q-gram of the long kind.
LONG_Q, SHORT_Q, LONG_ITEM = 8, 4, 64
#: Bytes that stand between texts; no q-gram of an item has them.
GAP = b"\xff" * LONG_Q
_PLAIN = bytes(0x20 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str | None) -> bytes:
    return (text or "").encode().translate(_PLAIN).lower()


class Grams(NamedTuple):
    """q-grams of the items that are searched with one q: sorted codes, and where each stands."""

    q: int
    bits: int
    filter: np.ndarray
    codes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray


class Index(NamedTuple):
    ids: list
    items: list[bytes]
    edits: np.ndarray
    least: np.ndarray
    grams: list[Grams]


def _codes(raw: bytes, q: int) -> np.ndarray:
    """The q bytes from every place on, as one number."""
    n = len(raw) - q + 1
    out = np.empty(max(n, 0), f"<u{q}")
    for shift in range(min(q, max(n, 0))):
        out[shift::q] = np.frombuffer(raw, f"<u{q}", count=(len(raw) - shift) // q, offset=shift)
    return out.astype(np.uint64)


def _slot(codes: np.ndarray, bits: int) -> np.ndarray:
    return (codes * _FACTOR) >> np.uint64(64 - bits)


def build(rows: list[tuple]) -> Index:
    """Index of (id, text) rows."""
    rows = [(i, p) for i, t in rows if len(p := plain(t).strip()) >= MIN_BYTES]
    items = [p for _, p in rows]
    size = np.array([len(p) for p in items], np.int64)
    edits = (size * EDITS).astype(np.int64)
    qs = np.where(size >= LONG_ITEM, LONG_Q, SHORT_Q)
    grams = []
    for q in (LONG_Q, SHORT_Q):
        some = [i for i in range(len(items)) if qs[i] == q]
        if not some:
            continue
        each = [_codes(items[i], q) for i in some]
        code = np.concatenate(each)
        order = np.argsort(code, kind="stable")
        item = np.repeat(some, [len(c) for c in each])[order]
        place = np.concatenate([np.arange(len(c)) for c in each])[order]
        codes, first = np.unique(code[order], return_index=True)
        bits = max(16, int(len(codes)).bit_length() + 4)
        there = np.zeros(1 << bits, bool)
        there[_slot(codes, bits)] = True
        grams.append(Grams(q, bits, there, codes, np.r_[first, len(code)], item, place))
    return Index([i for i, _ in rows], items, edits, size - qs + 1 - edits * qs, grams)


def _hits(raw: bytes, g: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, diagonal and place in the item of every common q-gram."""
    codes = _codes(raw, g.q)
    at = np.flatnonzero(g.filter[_slot(codes, g.bits)])
    slot = np.minimum(np.searchsorted(g.codes, codes[at]), len(g.codes) - 1)
    known = g.codes[slot] == codes[at]
    at, slot = at[known], slot[known]
    count = g.first[slot + 1] - g.first[slot]
    entry = np.repeat(g.first[slot] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    return g.item[entry], np.repeat(at, count) - g.place[entry], g.place[entry]


def candidates(raw: bytes, index: Index) -> Iterator[tuple[int, int, int]]:
    """Item and first and last diagonal of every band with enough hits."""
    for g in index.grams:
        item, diagonal, place = _hits(raw, g)
        width = index.edits[item] + 1
        shift = 1 + max((len(p) for p in index.items), default=0)  # diagonals begin before the text
        band = (diagonal + shift) // width
        step = np.int64(1) << 40
        key, place = np.concatenate([item * step + band, item * step + np.maximum(band - 1, 0)]), np.r_[place, place]
        least = np.maximum(1, index.least)
        keys, at, counts = np.unique(key, return_inverse=True, return_counts=True)
        enough = counts >= least[keys // step]
        # bands with enough hits: how many of the item's q-grams do they have, each counted once?
        some = enough[at]
        pairs = np.unique(np.stack([at[some], place[some]]), axis=1)[0] if some.any() else at[:0]
        counts = np.bincount(pairs, minlength=len(keys))
        for key in keys[enough & (counts >= least[keys // step])]:
            i, b = divmod(int(key), 1 << 40)
            w = int(index.edits[i]) + 1
            yield i, b * w - shift, (b + 2) * w - 1 - shift


def align(item: bytes, raw: bytes, low: int, high: int, anchor: int | None = None) -> tuple[int, int]:
    """Fewest edits of the item on diagonals low to high, and where that place ends; ``anchor``: it must begin there."""
    size, width = len(item), high - low + 1
    text = np.full(size + width, -1, np.int16)
    a, b = max(low, 0), min(low + size + width, len(raw))
    if b > a:
        text[a - low : b - low] = np.frombuffer(raw, np.uint8, count=b - a, offset=a)
    steps = np.arange(width)
    cost = np.zeros(width, np.int64) if anchor is None else np.where(steps >= anchor - low, steps - (anchor - low), 1 << 20)
    for i, c in enumerate(item):
        new = cost + (text[i : i + width] != c)
        new[:-1] = np.minimum(new[:-1], cost[1:] + 1)
        cost = np.minimum.accumulate(new - steps) + steps  # letters of the text between
    best = int(cost.argmin())
    return int(cost[best]), low + best + size


def places(raw: bytes, index: Index, starts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, begin, end, edits) in a row of texts that begin at ``starts``; begin and end are bytes of the row."""
    found = set()
    for i, low, high in candidates(raw, index):
        item, k = index.items[i], int(index.edits[i])
        edits, end = align(item, raw, low - k, high + k)
        if edits > k:
            continue
        # the other way round, from the end that is known now
        back, width = raw[max(0, end - len(item) - k) : end][::-1], k
        edits, size = align(item[::-1], back, -width, width, anchor=0)
        begin = end - min(size, len(back))
        doc = int(np.searchsorted(starts, begin, side="right")) - 1
        if edits <= k and doc >= 0 and end > begin:
            found.add((doc, i, begin, end, edits))
    return sorted(found)


def best(found: set[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Places that overlap no better place of the same text and item, by place."""
    kept: dict[tuple[int, int], list] = {}
    for x in sorted(found, key=lambda x: (x[4], x)):
        own = kept.setdefault(x[:2], [])
        if not any(y[2] < x[3] and x[2] < y[3] for y in own):
            own.append(x)
    return sorted(x for own in kept.values() for x in own)


def search(texts: list[str | None], index: Index) -> list[tuple[int, object, int, int, int]]:
    """(text, item id, first character, end, edits) of every place in the texts."""
    if not index.items:
        return []
    raws = [plain(t) for t in texts]
    starts = np.cumsum([0, *(len(r) + len(GAP) for r in raws)])[:-1]
    row = GAP.join(raws)
    overlap = 2 * max(map(len, index.items)) + 64
    found = set()
    for begin in range(0, len(row), PIECE):
        for doc, i, a, b, edits in places(row[begin : begin + PIECE + overlap], index, starts - begin):
            found.add((doc, i, a + begin, b + begin, edits))
    out = []
    for doc, i, a, b, edits in best(found):
        raw = raws[doc]
        first, end = (len(raw[: x - starts[doc]].decode("utf-8", "ignore")) for x in (a, b))
        out.append((doc, index.ids[i], first, end, edits))
    return out


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> Iterator[Index]:
    """Indexes of bounded parts of the benchmark."""
    rows = benchmark.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b)
        index = build(sorted(((r["item"], r["text"]) for r in part.collect()), key=lambda r: (r[1], str(r[0]))))
        if index.items:
            yield index


def occurrences(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every place: the key, the item's id, first character and end, edits, and the similarity ``1 - edits / item length``."""
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kinds = rows.schema["key"].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"key {kinds[0]}, item {kinds[1]}, first_char bigint, end_char bigint, edits bigint, similarity double"
    out = documents.sparkSession.createDataFrame([], schema)
    for index in blocks(benchmark, item, item_text):
        out = out.unionByName(map_texts(rows, _finder(index, to_arrow_type(benchmark.schema[item].dataType)), schema))
    return out.withColumnsRenamed({"key": key, "item": item})


def _finder(index: Index, kind: pa.DataType):
    length = dict(zip(index.ids, map(len, index.items)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE_BYTES):
            found = search(part.column(1).to_pylist(), index)
            keys = part.column(0).take(pa.array([f[0] for f in found], pa.int64()))
            numbers = [pa.array([f[c] for f in found], pa.int64()) for c in (2, 3, 4)]
            similarity = pa.array([1 - f[4] / length[f[1]] for f in found], pa.float64())
            items = pa.array([f[1] for f in found], kind)
            yield pa.RecordBatch.from_arrays([keys, items, *numbers, similarity], names=["key", "item", "first_char", "end_char", "edits", "similarity"])

    return run


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``documents`` without the rows that hold an item; nothing is shuffled."""
    names = [f.name for f in documents.schema]
    at = names.index(text)
    for index in blocks(benchmark, item, item_text):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, at, SLICE_BYTES):
                bad = {f[0] for f in search(part.column(at).to_pylist(), index)}
                yield part.filter(pa.array([i not in bad for i in range(part.num_rows)]))

        documents = map_texts(documents, run, documents.schema)
    return documents
