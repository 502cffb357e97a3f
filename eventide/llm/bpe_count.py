"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made.

A word starts as one symbol for each UTF-8 byte, the last one marked as the end of the word. The heap holds the adjacent
pairs by rank and place, a linked list holds the symbols that are left. Popping the lowest pair and linking its
neighbours is one merge, and a word's tokens are its symbols minus its merges. A process counts each word once as long
as it remembers it, and a document is the sum over its words.

Text is prepared as the tokenizer file says: special strings are taken out first (one token each, as the library does by
default), then NFC, white space and lower case; the matches of the split pattern are the words.

Cases: null and empty texts count 0 tokens; texts of any length are counted whole; repeated rows give repeated results;
only the key and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.batches import process_memory, slices

SLICE_BYTES = 4_000_000
#: Words whose counts a Python process remembers; beyond that it starts anew. Longer words aren't remembered.
KNOWN_WORDS, KNOWN_LENGTH = 1_000_000, 64
_PLACE = 1 << 40


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class MergeCounter(dict):
    """Word -> number of tokens; a missing word is counted when it is asked for."""

    def __init__(self, spec: dict):
        import regex

        super().__init__()
        model = spec["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.end = model.get("end_of_word_suffix") or ""
        self.symbol = byte_characters()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def __missing__(self, word: str) -> int:
        n = self.count_word(word)
        if len(word) <= KNOWN_LENGTH:
            self[word] = n
        return n

    def count_word(self, word: str) -> int:
        symbols = [self.symbol[b] for b in word.encode()]
        symbols[-1] += self.end
        n, rank = len(symbols), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r * _PLACE + i for i in range(n - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        heapify(heap)
        merges = 0
        while heap:
            r, i = divmod(heappop(heap), _PLACE)
            j = after[i]
            if symbols[i] is None or j >= n or rank((symbols[i], symbols[j])) != r:
                continue  # an older entry of a place that has changed
            merges += 1
            symbols[i] += symbols[j]
            symbols[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((symbols[i], symbols[k]))) is not None:
                    heappush(heap, r * _PLACE + i)
            if (k := before[i]) >= 0 and (r := rank((symbols[k], symbols[i]))) is not None:
                heappush(heap, r * _PLACE + k)
        return n - merges

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts, n = [text], 0
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            n = len(parts) - 1
        for part in parts:
            plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()  # no rule for a word's last sigma
            n += sum(map(self.__getitem__, self.find(plain)))
        return n


def counter(content: str) -> MergeCounter:
    """The process's counter for a tokenizer."""
    return process_memory(("bpe_count", hash(content)), lambda: MergeCounter(json.loads(content)))


def count_tokens(documents: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns: the key, ``n_bytes`` (UTF-8) and ``n_tokens`` of every whole text."""
    spec = json.loads(Path(tokenizer).read_text(encoding="utf-8"))
    spec["model"]["vocab"] = {}  # counting needs the merges only
    content = json.dumps(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(content)
        for part in slices(batches, 1, SLICE_BYTES):
            if len(counts) > KNOWN_WORDS:
                counts.clear()
            n = pa.array([counts.count(t) for t in part.column(1).to_pylist()], pa.int64())
            size = pa.compute.binary_length(part.column(1)).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), size, n], names=["key", "n_bytes", "n_tokens"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("key", key)


def with_limit(counted: DataFrame, limit: int) -> DataFrame:
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
