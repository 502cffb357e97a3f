"""Line dedup by winnowing: later copies of runs of ``RUN_WORDS`` words or more are deleted, the first occurrence stays.

Lines are laid out anew wherever texts are copied, so the units that are hashed are pieces which their words define: a piece
ends after a word whose hash is the smallest of ``PIECE_WORDS`` consecutive ones. A passage is then cut alike wherever it
begins or ends in a line and wherever its lines are broken, but for its first and last words. An *item* are as many units as
it takes to have ``ITEM_WORDS`` words, and in every run of units with ``WINDOW_WORDS`` words the item with the smallest hash is
selected: a fingerprint. These numbers are chosen such that any equal runs of ``RUN_WORDS`` words hold an equal run of units,
and share its fingerprint, wherever they stand. Of what is deleted, lines and words are told.

Of all fingerprints only those that repeat keep their places: bare hashes are counted first. Each place is joined with the
fingerprint's first one in the order of (key, digest of the text, place); never all pairs. Both texts' words, as numbers,
are compared on that diagonal, and the match is extended both ways as far as words are equal.

The first place of a fingerprint may stand in other words than the passage that repeats. Runs of ``RUN_WORDS`` words with a
fingerprint that has further places, which the match with the first one leaves uncovered, are therefore joined with their own
first occurrence, by a hash of the run, and extended alike. A run is uncovered where it stands first, so that place is among
them. So exactly those words are deleted that belong to a run of ``RUN_WORDS`` words which stands at an earlier place of
the given texts, as far as hashes tell words apart (32 bits for each of the words compared on a diagonal).

Cases: null and empty texts and texts shorter than a run lose nothing; rows with a null key are passed on as they are
and are no source; rows with equal key and text are one document and keep or lose the same words; of further copies of a whole
text only the first has fingerprints, the others lose all words, if these are enough for a run; a text that repeats its
own words keeps the first ones; lines without a word stay, lines that lose all their words go; other columns are passed
on, names included. Hot fingerprints and hot sources are join keys with one row on the other side, which Spark splits;
nothing is gathered per fingerprint.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.batches import free_name, map_texts, slices
from eventide.llm.ngram_join import _mix, _powers, small, word_hashes
from eventide.session import release, stage

SLICE_BYTES = 2_000_000
RUN_WORDS = 50
PIECE_WORDS, ITEM_WORDS = 4, 10
#: A run of units in RUN_WORDS words, less what may be cut in another way at its ends.
WINDOW_WORDS = RUN_WORDS + 2 - 4 * PIECE_WORDS
_WORD = re.compile(r"\S+")


def plain(text: str) -> bytes:
    """Words with one space between them, a line feed before every line that has a word, and one at the end."""
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return ("\n" + "".join(line + "\n" for line in lines if line)).encode()


def _minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Place of the smallest value, the last of equal ones, in every range; ``last`` is included."""
    level = np.frexp(last - first + 1)[1] - 1
    best, least, size = np.empty(len(first), np.int64), np.arange(len(values)), 1
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        a, b = least[first[at]], least[last[at] - size + 1]
        best[at] = np.where(values[b] <= values[a], b, a)
        a, b = least[:-size], least[size:]
        least = np.where(values[b] <= values[a], b, a)
        size *= 2
    return best


def units(words: np.ndarray, text: np.ndarray, piece: int = PIECE_WORDS) -> np.ndarray:
    """First words of all units of words with hashes and numbers of texts."""
    begins = np.r_[True, text[1:] != text[:-1]] if len(words) else np.zeros(0, bool)
    whole = np.flatnonzero(text[: len(text) - piece + 1] == text[piece - 1 :]) if len(words) >= piece else np.zeros(0, np.int64)
    after = _minima(words, whole, whole + piece - 1) + 1
    begins[after[after < len(words)]] = True
    return np.flatnonzero(begins)


def selected(starts: np.ndarray, text: np.ndarray, words: np.ndarray, item_words: int = ITEM_WORDS, window_words: int = WINDOW_WORDS):
    """Windows of units, as their first units, and for each the first unit of its selected item; and hashes of all items.

    ``starts`` has the first word of every unit, ``text`` the text it belongs to, ``words`` the hashes of all words. No item
    or window goes beyond its text.
    """
    ends = np.r_[starts[1:], len(words)]
    up, down = _powers(len(words) + 1)
    total = np.r_[np.uint64(0), np.cumsum(words * up[: len(words)])]

    def reach(least: int) -> np.ndarray:
        """Last unit of the shortest run of so many words from each unit on, or one that is beyond all."""
        last = np.searchsorted(ends, starts + least)
        inside = np.minimum(last, max(0, len(starts) - 1))
        return np.where((last < len(starts)) & (text[inside] == text), last, len(starts))

    item, window = reach(item_words), reach(window_words)
    windows, items = np.flatnonzero(window < len(starts)), np.flatnonzero(item < len(starts))
    hashes = np.zeros(len(starts), np.uint64)
    hashes[items] = _mix((total[ends[item[items]]] - total[starts[items]]) * down[starts[items]])
    last = items[np.searchsorted(item[items], window[windows], "right") - 1] if len(windows) else windows
    return windows, _minima(hashes, windows, last), hashes


def fingerprints(hashes: list[int], words: list[int], item_words: int = ITEM_WORDS, window_words: int = WINDOW_WORDS) -> dict[int, int]:
    """First unit of every selected item of one text, and the item's hash; units have a hash and a number of words each."""
    sizes = np.array(words, np.int64)
    starts = np.cumsum(sizes) - sizes
    spread = np.zeros(int(sizes.sum()), np.uint64)
    spread[starts] = np.array(hashes, np.uint64)
    _, best, items = selected(starts, np.zeros(len(starts), np.int64), spread, item_words, window_words)
    return {i: int(items[i]) for i in np.unique(best).tolist()}


_PRINTS = ("item", "at", "low", "high")
_PLACES = ("first_line", "last_line", "source_line", "first_word", "last_word", "source_word")


def fingerprinted(texts: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Lists of all texts, as values and offsets: words (hashes of 32 bits), first words of lines, and fingerprints.

    A fingerprint has its item's hash and first word. ``low`` and ``high`` are the first words of the
    runs of ``RUN_WORDS`` words that look for it, as it is the first one that is selected within them wherever they stand.
    """
    raws = [plain(t) for t in texts]
    sizes = np.array([len(r) for r in raws], np.int64)
    data = b"".join(raws)
    words, at = word_hashes(data)
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    line = np.searchsorted(breaks, at)
    edges = np.searchsorted(at, np.r_[0, np.cumsum(sizes)])  # words before each text
    text = np.repeat(np.arange(len(texts)), np.diff(edges))
    begins = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(at) else at
    starts = units(words, text)
    own = text[starts]
    windows, best, hashes = selected(starts, own, words)
    item, first, n = np.unique(best, return_index=True, return_counts=True)
    base = edges[own[item]]
    # of the windows that select an item, the first and the last; what lies before the first looks for another item
    before = windows[first] - 1
    fresh = (windows[first] == 0) | (own[np.maximum(before, 0)] != own[item])
    low = np.where(fresh, 0, np.maximum(starts[np.maximum(before, 0)] - PIECE_WORDS + 1 - base, 0))
    high = starts[windows[first + n - 1]] - PIECE_WORDS - base
    lists = {
        "words": (words.astype(np.uint32).view(np.int32), edges),
        "lines": (begins - edges[text[begins]], np.searchsorted(begins, edges)),
    }
    cuts = np.searchsorted(own[item], np.arange(len(texts) + 1))
    for name, value in zip(_PRINTS, (hashes[item].view(np.int64), starts[item] - base, low, high)):
        lists[name] = value, cuts
    return lists


def hashed_words(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Per document: key, digest of the text, number of words, and the lists of ``fingerprinted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, SLICE_BYTES):
            lists = fingerprinted(part.column(2).to_pylist())
            arrays = [
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values if name == "item" else values.astype(np.int32)))
                for name, (values, offsets) in lists.items()
            ]
            n = pa.array(np.diff(lists["words"][1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n, *arrays], names=["key", "digest", "n", *lists])

    rows = documents.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(
        F.col(key).alias("key"), digest(F.col(text)).alias("digest"), F.col(text).cast("string").alias("text")
    )
    kind = rows.schema["key"].dataType.simpleString()
    return map_texts(rows, run, f"key {kind}, digest binary, n int, words array<int>, lines array<int>, item array<bigint>, " + ", ".join(f"{c} array<int>" for c in _PRINTS[1:]))


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _lists(column: pa.ListArray, field: str | None = None) -> list[np.ndarray]:
    """Values of a list column, or of a field of its structs, per row."""
    values = (column.values.field(field) if field else column.values).to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _equal_run(mine: np.ndarray, theirs: np.ndarray, shift: int, at: int) -> tuple[int, int]:
    """The longest run of my words around ``at`` that are equal to theirs ``shift`` words before."""
    low, high = max(0, shift), min(len(mine), len(theirs) + shift)
    step, first, last = 256, at, at + 1
    while first > low:  # in growing steps, so that the work follows the length of the run
        a = max(low, first - step)
        other = np.flatnonzero(mine[a:first] != theirs[a - shift : first - shift])
        if len(other):
            first = a + int(other[-1]) + 1
            break
        first, step = a, 2 * step
    step = 256
    while last < high:
        b = min(high, last + step)
        other = np.flatnonzero(mine[last:b] != theirs[last - shift : b - shift])
        if len(other):
            last += int(other[0])
            break
        last, step = b, 2 * step
    return first, last


def matches(mine: np.ndarray, theirs: np.ndarray, at: np.ndarray, source: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of at least ``RUN_WORDS`` words around some places of mine, as first word, word behind the last, and shift.

    Places whose runs of words from ``low`` to ``high`` all lie in a run that is found don't need to be followed.
    """
    found, done = [], np.zeros(len(at), bool)
    for i in np.argsort(at, kind="stable"):
        if done[i]:
            continue
        shift = int(at[i] - source[i])
        a, b = _equal_run(mine, theirs, shift, int(at[i]))
        done |= (at >= a) & (at < b) & (at - source == shift)
        if b - a >= RUN_WORDS:
            found.append((a, b, shift))
            done |= (low >= a) & (high + RUN_WORDS <= b)
    return found


def _open_runs(mine: np.ndarray, low: np.ndarray, high: np.ndarray, found: list[tuple[int, int, int]]) -> np.ndarray:
    """First words of the runs of ``RUN_WORDS`` words between some bounds that no match covers."""
    if not len(low):
        return np.zeros(0, np.int64)
    at = np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high)])
    for a, b, _ in found:
        at = at[(at < a) | (at + RUN_WORDS > b)]
    return at


def _run_hashes(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    up, down = _powers(len(words) + 1)
    total = np.r_[np.uint64(0), np.cumsum((words.view(np.uint32).astype(np.uint64) + np.uint64(1)) * up[: len(words)])]
    return _mix((total[at + RUN_WORDS] - total[at]) * down[at]).view(np.int64)


def _runs(hashed: DataFrame, later: DataFrame) -> DataFrame:
    """Runs around places (``key``, ``digest``, ``at``, ``low``, ``high``, ``open``) that are equal at their ``source``.

    Rows with a ``mark`` are the runs of words, from ``low`` to ``high`` of the places that are ``open``, that no match covers.
    """
    pair = ["key", "digest", "source_key", "source_digest"]
    seeds = later.groupBy("key", "digest", F.col("source.key").alias("source_key"), F.col("source.digest").alias("source_digest")).agg(
        F.collect_set(F.struct("at", F.col("source.at").alias("source"), "low", "high", "open")).alias("seeds")  # of one text
    )
    seeds = stage(seeds, "seeds")
    keys = seeds.select("key", "digest").unionByName(seeds.select(F.col("source_key").alias("key"), F.col("source_digest").alias("digest"))).distinct()
    keys = stage(keys, "keys")
    texts = hashed.select("key", "digest", "words", "lines").join(small(keys), ["key", "digest"], "left_semi").dropDuplicates(["key", "digest"])
    theirs = texts.select(*[F.col(a).alias(b) for a, b in zip(("key", "digest", "words", "lines"), ("source_key", "source_digest", "theirs", "their_lines"))])
    pairs = seeds.join(texts, ["key", "digest"]).join(theirs, ["source_key", "source_digest"]).select(*pair, "seeds", "words", "lines", "theirs", "their_lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = [_lists(batch.column(4), c) for c in ("at", "source", "low", "high", "open")]
            words, lines, theirs, their_lines = (_lists(batch.column(c)) for c in range(5, 9))
            rows, places, marked, marks, firsts = [], [], [], [], []
            for i in range(batch.num_rows):
                at, source, low, high, more = (s[i] for s in seeds)
                found = matches(words[i], theirs[i], at, source, low, high)
                for a, b, shift in found:
                    line = np.searchsorted(lines[i], (a, b - 1), "right") - 1
                    rows.append(i)
                    places.append((line[0], line[1], np.searchsorted(their_lines[i], a - shift, "right") - 1, a, b - 1, a - shift))
                runs = _open_runs(words[i], low[more], np.minimum(high[more], len(words[i]) - RUN_WORDS), found)
                if len(runs):
                    marked.append(np.full(len(runs), i))
                    marks.append(_run_hashes(words[i], runs))
                    firsts.append(runs)
            n, m = len(rows), sum(map(len, marks))
            taken = batch.select([0, 1, 2, 3]).take(pa.array(np.concatenate([np.array(rows, np.int64), *marked])))
            table = np.array(places, np.int32).reshape(n, len(_PLACES))
            new = [pa.concat_arrays([pa.array(c), pa.nulls(m, pa.int32())]) for c in table.T]
            mark = pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *marks]))])
            first = pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *firsts]).astype(np.int32))])
            yield pa.RecordBatch.from_arrays([*taken.columns, *new, mark, first], names=[*pair, *_PLACES, "mark", "at"])

    kind = hashed.schema["key"].dataType.simpleString()
    out = stage(map_texts(pairs, run, f"key {kind}, digest binary, source_key {kind}, source_digest binary, " + ", ".join(f"{c} int" for c in _PLACES) + ", mark bigint, at int"), "found")
    release(seeds, keys)
    return out


def _repeated(places: DataFrame, mark: str) -> tuple[DataFrame, list[DataFrame]]:
    """Places whose ``mark`` stands at another place too, with the first of these and their number ``times``; and what is staged for it.

    Bare marks are counted first, so that places that stand alone, most of them, are neither sorted nor joined. What marks are
    joined with is staged: few rows are broadcast, and beyond that a join of its own can be split where a mark is hot.
    """
    place = F.struct("key", "digest", "at")
    times = stage(places.groupBy(mark).count().where("count > 1").withColumnRenamed("count", "times"), "times")
    several = stage(places.join(small(times), mark), "several")
    first = stage(several.groupBy(mark).agg(F.min(place).alias("source")), "first")
    return several.join(small(first), mark).where(place != F.col("source")), [times, several, first]


def repeated_runs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs to delete: key, digest, first and last word and their lines (among lines with a word), and where the run stands first."""
    hashed = stage(hashed_words(documents, key, text), "words")
    first = hashed.groupBy("digest").agg(F.min("key").alias("source_key"), F.max("key").alias("last")).where("last > source_key")
    copies = hashed.select("key", "digest", "n", F.size("lines").alias("lines")).join(first.drop("last"), "digest").where("key > source_key")
    copies = stage(copies.distinct(), "copies")
    zero = F.lit(0)
    whole = copies.where(F.col("n") >= RUN_WORDS).select(
        "key", "digest", "source_key", F.col("digest").alias("source_digest"), zero.alias("first_line"), (F.col("lines") - 1).alias("last_line"), zero.alias("source_line"),
        zero.alias("first_word"), (F.col("n") - 1).alias("last_word"), zero.alias("source_word"))
    firsts = hashed.select("key", "digest", *_PRINTS).join(small(copies.select("key", "digest")), ["key", "digest"], "left_anti")
    prints = firsts.select("key", "digest", F.explode(F.arrays_zip(*_PRINTS)).alias("p")).select("key", "digest", "p.*")
    later, staged = _repeated(prints, "item")
    # of two places the later has no other source
    found = _runs(hashed, later.withColumn("open", F.col("times") > 2))
    release(*staged)
    windows = found.where("mark is not null").select("key", "digest", "mark", "at").distinct()
    later, staged = _repeated(windows, "mark")
    again = _runs(hashed, later.select("*", F.col("at").alias("low"), F.col("at").alias("high"), F.lit(False).alias("open")))
    release(*staged, hashed)
    runs = found.where("mark is null").drop("mark", "at").unionByName(again.where("mark is null").drop("mark", "at"))
    return runs.unionByName(whole).distinct()


def dedup(documents: DataFrame, key: str = "doc_id", text: str = "text", drop_emptied: bool = False) -> DataFrame:
    """``documents`` without repeated runs, all columns and rows kept; ``drop_emptied``: but for rows that lose their last line."""
    runs = repeated_runs(documents, key, text).groupBy("key", "digest").agg(F.collect_set(F.struct("first_word", "last_word")).alias("runs"))
    columns = documents.columns
    run_key, run_digest, cuts = (free_name(columns, c) for c in ("run_key", "run_digest", "runs"))
    runs = runs.select(F.col("key").alias(run_key), F.col("digest").alias(run_digest), F.col("runs").alias(cuts))
    joined = documents.join(runs, (F.col(key) == F.col(run_key)) & (digest(F.col(text)) == F.col(run_digest)), "left")
    names = [f.name for f in documents.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for part in slices(batches, at, SLICE_BYTES):
            texts, gone = part.column(at).to_pylist(), part.column(len(names)).to_pylist()
            left = [t if r is None else without(t, r) for t, r in zip(texts, gone)]
            out = pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(left, pa.string()), *part.columns[at + 1 : -1]], names=names)
            if drop_emptied:
                out = out.filter(pa.array([r is None or bool(t.strip()) for t, r in zip(left, gone)]))
            yield out

    return map_texts(joined.select(*columns, cuts), run, documents.schema)


def without(text: str, runs: list[dict]) -> str:
    """A text without the words of ``runs``; lines that lose all their words go, others without the space after a lost word."""
    gone = {i for r in runs for i in range(r["first_word"], r["last_word"] + 1)}
    left, n = [], 0
    for line in text.split("\n"):
        spans = [m.span() for m in _WORD.finditer(line)]
        stay = [i for i in range(len(spans)) if n + i not in gone]
        n += len(spans)
        if len(stay) == len(spans):
            left.append(line)
        elif stay:
            ends = [a for a, _ in spans[1:]] + [len(line)]
            part = "".join(line[spans[i][0] : ends[i]] for i in stay)
            left.append(line[: spans[0][0]] + (part if stay[-1] == len(spans) - 1 else part.rstrip()))
    return "\n".join(left)
