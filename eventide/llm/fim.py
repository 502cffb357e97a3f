"""Fill-in-the-middle transformation: texts are cut at two units and their parts put in another order.

A unit is a run of ASCII letters or any other single code point. Over blocks of ``BLOCK`` bytes of a text, a Fenwick tree
holds how many units and how many code points begin in each. To find where a unit begins, binary lifting goes down the
tree to its block, with the units and code points before the block, and only this block is searched for the place. The
number of units, too, is read off the tree. Units are seen from the bytes: one begins at each first byte of a code point
but for a letter after a letter, whatever block these lie in.

The cuts and the form of a row come from the first four groups of eight digits of the SHA-256 of ``seed``, a colon and the
key: the middle lies between the unit numbers ``h1 % (n + 1)`` and ``h2 % (n + 1)``; ``h3 % 100`` decides whether the text
stays as it is, ``h4 % 100`` whether the suffix comes first.

Cases: null and empty texts stay plain and give an empty output; texts that hold a mark stay plain, so that the output can
always be cut at its marks again (a mark can't arise where parts and marks meet); prefix, middle and suffix may each be
empty; a null key is hashed as ``-``; repeated rows get equal results; a text of any length is worked on whole; columns
other than the key and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.batches import slices

SLICE_BYTES = 4_000_000
BLOCK = 1_024
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
#: Of a hundred texts, so many are rearranged, and of a hundred of those so many begin with the suffix.
REARRANGED, SUFFIX_FIRST = 90, 20
SEED = "1"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_BEGINS = (np.arange(256) & 0xC0) != 0x80  # not a continuation byte


class Fenwick:
    """Prefix sums of two counts per block, with descent by the first."""

    def __init__(self, units: list[int], chars: list[int]):
        self.units, self.chars, n = [0, *units], [0, *chars], len(units)
        for i in range(1, n + 1):
            up = i + (i & -i)
            if up <= n:
                self.units[up] += self.units[i]
                self.chars[up] += self.chars[i]
        self.top = 1 << n.bit_length() >> 1
        self.total = self.before(n)

    def before(self, block: int) -> tuple[int, int]:
        """Units and code points of the first ``block`` blocks."""
        units = chars = 0
        while block:
            units += self.units[block]
            chars += self.chars[block]
            block &= block - 1
        return units, chars

    def descend(self, unit: int) -> tuple[int, int, int]:
        """The block in which a unit begins, and the units and code points before that block."""
        at = units = chars = 0
        step = self.top
        while step:
            to = at + step
            if to < len(self.units) and units + self.units[to] <= unit:
                at, units, chars = to, units + self.units[to], chars + self.chars[to]
            step >>= 1
        return at, units, chars


def beginnings(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte whether a unit and whether a code point begins there; ``first`` has the first byte of every text."""
    points, letters = _BEGINS[data], _LETTER[data]
    joined = letters.copy()
    joined[1:] &= letters[:-1]
    joined[first] = False
    return points & ~joined, points


def draws(key: str | None, seed: str = SEED) -> list[int]:
    hexed = hashlib.sha256(f"{seed}:{'-' if key is None else key}".encode()).hexdigest()
    return [int(hexed[i : i + 8], 16) for i in (0, 8, 16, 24)]


def _arrange(raw: bytes, key: str | None, units: np.ndarray, points: np.ndarray, tree: Fenwick, seed: str) -> tuple:
    """Units, form, code points of prefix and middle, and the output of one text."""
    h1, h2, h3, h4 = draws(key, seed)
    n = tree.total[0]
    if not raw or h3 % 100 >= REARRANGED or any(m in raw for m in _MARKS):
        return n, "plain", None, None, raw
    cuts = []
    for unit in sorted((h1 % (n + 1), h2 % (n + 1))):
        if unit == n:
            cuts.append((len(raw), tree.total[1]))
            continue
        block, before, chars = tree.descend(unit)
        low = block * BLOCK
        at = int(np.flatnonzero(units[low : low + BLOCK])[unit - before])
        cuts.append((low + at, chars + int(np.count_nonzero(points[low : low + at]))))
    (a, chars_a), (b, chars_b) = cuts
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    p, s, m = _MARKS
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", chars_a, chars_b - chars_a, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", chars_a, chars_b - chars_a, b"".join((p, prefix, s, suffix, m, middle))


def arranged(texts: list[bytes], keys: list[str | None], seed: str = SEED) -> list[tuple]:
    """``_arrange`` for many texts: beginnings and block counts are found for all of them at once."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.r_[0, np.cumsum(sizes)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    units, points = beginnings(data, first[:-1][sizes > 0])
    blocks = -(-sizes // BLOCK)
    ends = np.cumsum(blocks)
    inner = np.arange(int(blocks.sum())) - np.repeat(ends - blocks, blocks)
    edges = np.repeat(first[:-1], blocks) + inner * BLOCK
    counts = [np.add.reduceat(x, edges, dtype=np.int64).tolist() if len(edges) else [] for x in (units, points)]
    out = []
    for i, (raw, key) in enumerate(zip(texts, keys)):
        low, high = int(ends[i] - blocks[i]), int(ends[i])
        a, b = int(first[i]), int(first[i + 1])
        tree = Fenwick(counts[0][low:high], counts[1][low:high])
        out.append(_arrange(raw, key, units[a:b], points[a:b], tree, seed))
    return out


def transform(documents: DataFrame, key: str = "doc_id", text: str = "text", seed: str = SEED) -> DataFrame:
    """Per row: the key, ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``."""
    rows = documents.select(F.col(key).alias("key"), F.col(key).cast("string").alias("name"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, SLICE_BYTES):
            texts = part.column(2).cast(pa.binary()).to_pylist()
            found = arranged(texts, part.column(1).to_pylist(), seed)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            new = [pa.array([f[c] for f in found], kind) for c, kind in enumerate(kinds)]
            new[4] = new[4].cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *new], names=["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["key"].dataType.simpleString()
    made = rows.mapInArrow(run, f"key {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return made.select(F.col("key").alias(key), "n", "form", "prefix_chars", "middle_chars", "output")


def restored(transformed: DataFrame) -> DataFrame:
    """``transformed`` with the text, rebuilt from ``output`` and ``form`` alone, in the column ``restored``."""
    parts = F.split("output", f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    in_order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    text = F.col("output")
    for form, order in in_order.items():
        text = F.when(F.col("form") == form, F.concat(*[parts[i] for i in order])).otherwise(text)
    return transformed.withColumn("restored", text)


def oracle(key: str = "doc_id", text: str = "text", seed: str = SEED) -> str:
    """The query in SQL: units as a list, cut by places of the list."""
    h = lambda i: f"cast('0x' || substr(h, {8 * i + 1}, 8) as bigint)"
    part = lambda a, b: f"array_to_string(u[{a}:{b}], '')"
    return f"""
  select {key}, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
      else '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle end) as output_sha256, sha256(t) as restored_sha256
  from (
    select *, {part('1', 'a')} as prefix, {part('a + 1', 'b')} as middle, {part('b + 1', 'n')} as suffix,
      case when t = '' or contains(t, '{PREFIX}') or contains(t, '{SUFFIX}') or contains(t, '{MIDDLE}') or {h(2)} % 100 >= {REARRANGED} then 'plain'
        when {h(3)} % 100 < {SUFFIX_FIRST} then 'spm' else 'psm' end as form
    from (
      select *, least({h(0)} % (n + 1), {h(1)} % (n + 1)) as a, greatest({h(0)} % (n + 1), {h(1)} % (n + 1)) as b
      from (
        select *, cast(len(u) as bigint) as n from (
          select {key}, t, sha256('{seed}:' || coalesce(cast({key} as varchar), '-')) as h, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as u
          from (select {key}, coalesce({text}, '') as t from documents) d) e) f) g) k"""
