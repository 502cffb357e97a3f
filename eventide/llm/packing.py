"""Token-id matrices by best-fit-decreasing packing with a segment tree over capacities.

Texts become token ids, texts of more ids than a row are split into pieces (a row each, and a rest), and pieces are packed
in order of decreasing length, each into the open row with the least space that is enough. A segment tree over the
possible spaces tells which spaces have an open row, so that search takes as many steps as the row length has bits.

A task packs its documents in shards of about ``SHARD_TOKENS`` ids, in the order in which it reads them, and never shuffles;
memory follows the shard and the longest text. A shard is one matrix of little-endian unsigned 32-bit ids, ``width`` a row,
filled up with ``pad``; ``cu_seqlens`` are the rows' cumulative segment lengths (each row begins with 0), and ``positions``
begin anew at 0 with every segment. ``doc_ids`` and ``offsets`` tell which ids of which document a segment holds, so
``unpack`` gives back every document's ids.

Cases: null and empty texts have no ids, hence no segment; rows with equal keys are packed as documents of their own, and
``unpack`` tells them apart by nothing but their places; a null key is carried; only key and text are read. Shard numbers
are the reading task's number and a count, so they're repeatable for the same input files.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.batches import process_memory, slices
from eventide.llm.byte_bpe import read_ranks

SLICE_BYTES = 4_000_000
WIDTH, SHARD_TOKENS = 2048, 1_000_000


class Piece(NamedTuple):
    doc: int  # number of the document in the shard
    offset: int
    size: int


class Spaces:
    """Segment tree over spaces 0..width: how many open rows have a space within each node's range."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        node = self.leaves + space
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Smallest space of at least ``least`` that an open row has, and that row, which is taken out."""
        node = self.leaves + least
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1  # up, until there is something to the right
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        space = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return space, self.rows[space].pop()


def split(sizes: list[int], width: int = WIDTH) -> list[Piece]:
    return [Piece(d, at, min(width, n - at)) for d, n in enumerate(sizes) for at in range(0, n, width)]


def pack(pieces: list[Piece], width: int = WIDTH) -> list[list[Piece]]:
    """Rows of pieces by best fit, longest first."""
    rows: list[list[Piece]] = []
    spaces = Spaces(width)
    for piece in sorted(pieces, key=lambda p: (-p.size, p.doc, p.offset)):
        found = spaces.take(piece.size)
        if found is None:
            found = width, len(rows)
            rows.append([])
        space, row = found
        rows[row].append(piece)
        if space > piece.size:
            spaces.add(space - piece.size, row)
    return rows


class Shard(NamedTuple):
    ids: np.ndarray  # rows x width
    positions: np.ndarray
    rows: list[list[Piece]]


def matrix(ids: list[np.ndarray], width: int = WIDTH, pad: int = 0) -> Shard:
    rows = pack(split([len(x) for x in ids], width), width)
    out, positions = np.full((len(rows), width), pad, "<u4"), np.zeros((len(rows), width), "<u4")
    for r, row in enumerate(rows):
        at = 0
        for p in row:
            out[r, at : at + p.size] = ids[p.doc][p.offset : p.offset + p.size]
            positions[r, at : at + p.size] = np.arange(p.size)
            at += p.size
    return Shard(out, positions, rows)


def encoding(content: bytes, pattern: str):
    """The process's tokenizer for a vocabulary."""
    import tiktoken

    make = lambda: tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=read_ranks(content), special_tokens={})
    return process_memory(("packing", hash(content), pattern), make)


def packed(documents: DataFrame, vocabulary: str, pattern: str, width: int = WIDTH, pad: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per shard: ``shard``, ``n_rows``, ``width``, and per matrix row ``ids``, ``positions`` (binary), ``doc_ids``, ``offsets``, ``cu_seqlens``."""
    content = Path(vocabulary).read_bytes()
    fill = len(read_ranks(content)) if pad is None else pad  # the first number that is no id
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    names = ["shard", "n_rows", "width", "ids", "positions", "doc_ids", "offsets", "cu_seqlens"]

    def shard(number: int, keys: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
        m = matrix(ids, width, fill)
        lists = pa.list_(pa.list_(pa.int32()))
        doc_ids = pa.ListArray.from_arrays(np.cumsum([0, *map(len, m.rows)]).astype(np.int32), keys.take(pa.array([p.doc for r in m.rows for p in r], pa.int64())))
        ends = [[0, *np.cumsum([p.size for p in r]).tolist()] for r in m.rows]
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([len(m.rows)], pa.int32()), pa.array([width], pa.int32()),
            pa.array([[r.tobytes() for r in m.ids]], pa.list_(pa.binary())), pa.array([[r.tobytes() for r in m.positions]], pa.list_(pa.binary())),
            pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids),
            pa.array([[[p.offset for p in r] for r in m.rows]], lists), pa.array([ends], lists),
        ], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = encoding(content, pattern), TaskContext.get().partitionId() << 32
        keys, ids, size = [], [], 0
        for part in slices(batches, 1, SLICE_BYTES):
            keys.append(part.column(0))
            new = [np.array(coder.encode_ordinary(t) if t else [], "<u4") for t in part.column(1).to_pylist()]
            ids += new
            size += sum(map(len, new))
            if size >= SHARD_TOKENS:
                yield shard(number, pa.concat_arrays(keys), ids)
                number, keys, ids, size = number + 1, [], [], 0
        if size:
            yield shard(number, pa.concat_arrays(keys), ids)

    return rows.mapInArrow(run, f"shard bigint, n_rows int, width int, ids array<binary>, positions array<binary>, doc_ids array<array<{kind}>>, offsets array<array<int>>, cu_seqlens array<array<int>>")


def write(shards: DataFrame, path: str) -> None:
    """Write the matrices: one row per shard, binary columns as they are."""
    shards.write.parquet(path)


def matrix_rows(shards: DataFrame) -> DataFrame:
    """One row per matrix row: ``shard``, ``row``, ``doc_ids``, ``offsets``, ``cu_seqlens``, ``ids`` and ``positions`` of the row (binary, padded)."""
    each = F.posexplode(F.arrays_zip("doc_ids", "offsets", "cu_seqlens", "ids", "positions")).alias("row", "r")
    return shards.select("shard", each).select("shard", "row", "r.*")


def unpack(shards: DataFrame) -> DataFrame:
    """Segments again: ``doc_id``, ``offset`` and ``ids`` (binary) of every segment."""
    rows = matrix_rows(shards)
    s = rows.select("ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "offsets")).alias("i", "s"))
    first, last = F.get("cu_seqlens", F.col("i")), F.get("cu_seqlens", F.col("i") + 1)
    return s.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.offsets").alias("offset"), F.substring("ids", first * 4 + 1, (last - first) * 4).alias("ids"))
