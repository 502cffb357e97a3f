"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside Spark tasks.

Every text is cut by the pre-tokenizer's pattern; each match is one word. A word that is itself in the vocabulary is
that one id. The other words of a slice that the process has not met yet become rows ``(w, pos, tok)``, one for each
byte, and a recursive query joins neighbouring tokens with the merge table and contracts, in every word, its leftmost
pair of minimum rank until no pair can be merged. Decoding joins ids with the vocabulary and concatenates the pieces of
a document in an ordered aggregation.

For long words one round may contract several places of a word, if that is provably the same: rank ``r`` stands for one byte string,
and where no token of a lower rank starts or ends with that string, contracting one place can't create a better pair, so
the next leftmost minimum is the next place that doesn't overlap the last. For all other ranks, and for
all short words, a round contracts one place of a word.

Cases: a null or empty text has no ids (both digests are those of no bytes); texts of any length are worked on whole;
repeated rows give repeated results; columns other than the key and the text are not read, so their names can't clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.batches import map_texts, process_memory, slices

#: Bytes of text that a task works on at a time (a longer text is worked on alone, and whole).
SLICE_BYTES = 4_000_000
#: Words whose ids a Python process remembers, in two generations: words met in the younger one outlive the older.
KNOWN_WORDS = 500_000
#: Byte rows that one recursive query starts from (a longer word is worked on alone).
QUERY_ROWS = 300_000
#: Ids that one query decodes (those of a longer text are decoded alone).
DECODE_IDS = 250_000
#: Words of more bytes take the query for long words.
SHORT = 40

#: One place per word and round: the leftmost minimum is an aggregate, so no round sorts. For words of few bytes, whose
#: rounds are few. Rows: word, number of the token in the word, token, next token, their merge, round.
CONTRACT = """
with recursive s(w, n, tok, next, id, round) as (
  select w, n, tok, next, id, 0 from symbols left join merges on l = tok and r = next
  union all
  select w, n, tok, next, merges.id, round
  from (
    select a.w, case when a.n > head then a.n - 1 else a.n end as n,
      case when a.n = head then new else a.tok end as tok,
      case when a.n = head then after when a.n = head - 1 then new else a.next end as next,
      a.round + 1 as round
    from s a join (
      select b.w, b.best % 1048576 as head, b.best // 1048576 as new, c.next as after
      from (select w, min(id::bigint * 1048576 + n) as best from s where id is not null group by w) b
        join s c on c.w = b.w and c.n = b.best % 1048576 + 1
    ) h on a.w = h.w
    where a.n <> head + 1
  ) left join merges on l = tok and r = next
)
select w, list(tok order by n) as ids
from s join (select w, max(round) as round from s group by w) using (w, round) group by w order by w
"""

#: Many places per word and round, where that is safe: for long words.
CONTRACT_LONG = """
with recursive s(w, pos, tok, done) as (
  select w, n, tok, false from symbols
  union all
  select w, pos, case when taken then id else tok end, low is null
  from (
    select w, pos, tok, id, low,
      case when safe_low then id = low and run % 2 = 0 else n = head end as taken,
      case when safe_low then run % 2 = 1 else n = head + 1 end as gone
    from (
      select *,
        bool_or(safe and id = low) over word as safe_low,
        min(case when id = low then n end) over word as head,
        n - 1 - coalesce(max(case when id = low then 0 else n end) over (
          partition by w order by pos rows between unbounded preceding and 1 preceding), 0) as run
      from (
        select *, min(id) over (partition by w) as low
        from (
          select w, pos, tok, lead(tok) over place as next, row_number() over place as n
          from s where not done window place as (partition by w order by pos)
        ) left join merges on l = tok and r = next
      ) window word as (partition by w)
    )
  )
  where gone is distinct from true
)
select w, list(tok order by pos) as ids from s where done group by w order by w
"""

DECODE = """
select doc, array_to_string(list(piece order by pos), '') as text from tokens join vocabulary using (id) group by doc order by doc
"""


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Byte strings and their ranks, from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """All pairs of ids whose bytes together are a token; ``safe``: see the module's text."""
    best: dict[bytes, int] = {}
    for token, rank in ranks.items():
        for j in range(1, len(token)):
            for part in (token[:j], token[j:]):
                best[part] = min(rank, best.get(part, rank))
    rows = [
        (ranks[token[:j]], ranks[token[j:]], rank, best.get(token, rank) >= rank)
        for token, rank in ranks.items()
        for j in range(1, len(token))
        if token[:j] in ranks and token[j:] in ranks
    ]
    types = (pa.int32(), pa.int32(), pa.int32(), pa.bool_())
    columns = zip(*rows) if rows else [[], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["l", "r", "id", "safe"])


class Words(dict):
    """Word -> number, and the ids of all words in a row; a new word gets the next number when it is asked for."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.flat = np.zeros(0, "<u4")
        self.ends = np.zeros(1, np.int64)  # of word n: flat[ends[n] : ends[n + 1]]

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def ids(self, n: int) -> bytes:
        return self.flat[self.ends[n] : self.ends[n + 1]].tobytes()

    def store(self, found: list[bytes]) -> None:
        """Ids of the new words, in their order."""
        self.new = []
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(found), "<u4")])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(f) // 4 for f in found], dtype=np.int64)])

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and where each word's ids end."""
        sizes = (self.ends[1:] - self.ends[:-1])[numbers]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.ends[numbers] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


class Coder:
    """One DuckDB connection in memory with the vocabulary, and the ids of the words met lately."""

    def __init__(self, content: bytes, pattern: str):
        import duckdb
        import regex

        self.ranks = read_ranks(content)
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary has no token for the bytes {missing}")
        self.find = regex.compile(pattern).findall
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        self.con.execute("set enable_progress_bar = false")
        self._table("merges", merge_table(self.ranks))
        self._table("vocabulary", pa.table({
            "id": pa.array(list(self.ranks.values()), pa.int32()),
            "piece": [t.decode("latin-1") for t in self.ranks],  # one character for each byte
        }))
        self.known, self.before = Words(), Words()  # the younger and the older generation

    def _table(self, name: str, rows: pa.Table) -> None:
        self.con.register("arrow_rows", rows)
        self.con.execute(f"create table {name} as select * from arrow_rows")
        self.con.unregister("arrow_rows")

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        tok = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        following = np.r_[tok[1:], np.int32(-1)]
        following[ends - 1] = -1  # nothing follows a word's last byte
        symbols = pa.table({
            "w": np.repeat(np.arange(len(words), dtype=np.int32), lengths),
            "n": np.arange(1, len(tok) + 1, dtype=np.int32) - np.repeat(ends - lengths, lengths).astype(np.int32),
            "tok": tok,
            "next": following,
        })
        self.con.register("symbols", symbols)
        lists = self.con.sql(CONTRACT if lengths.max() <= SHORT else CONTRACT_LONG).to_arrow_table().column("ids").combine_chunks()
        self.con.unregister("symbols")
        ids = lists.values.to_numpy().astype("<u4").tobytes()
        ends = lists.offsets.to_numpy() * 4
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def learn(self) -> None:
        """Ids of the new words: those of the older generation, whole tokens, or contracted."""
        words = self.known.new
        found: list[bytes | None] = []
        short, long = [], []
        for i, word in enumerate(words):
            n = self.before.get(word)
            raw = word.encode() if n is None else b""
            whole = self.ranks.get(raw)
            found.append(self.before.ids(n) if n is not None else None if whole is None else whole.to_bytes(4, "little"))
            if found[-1] is None:
                (short if len(raw) <= SHORT else long).append((i, raw))
        for some in (short, long):
            start = size = 0
            for i in range(len(some) + 1):
                if i == len(some) or (i > start and size + len(some[i][1]) > QUERY_ROWS):
                    part = some[start:i]
                    for (at, _), ids in zip(part, self.contract([raw for _, raw in part]) if part else []):
                        found[at] = ids
                    start, size = i, 0
                if i < len(some):
                    size += len(some[i][1])
        self.known.store(found)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > KNOWN_WORDS // 2:
            self.before, self.known = self.known, Words()
        number = self.known.__getitem__
        numbers = [np.fromiter(map(number, self.find(t)), np.int32) if t else np.zeros(0, np.int32) for t in texts]
        if self.known.new:
            self.learn()
        ids, ends = self.known.gather(np.concatenate(numbers) if numbers else np.zeros(0, np.int32))
        last = np.r_[0, ends][np.cumsum([0, *map(len, numbers)])]
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(last[:-1].tolist(), last[1:].tolist())]

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        out, start, size = [], 0, 0
        for i, ids in enumerate(encoded):
            if i > start and size + len(ids) > 4 * DECODE_IDS:
                out += self._decode(encoded[start:i])
                start, size = i, 0
            size += len(ids)
        return out + self._decode(encoded[start:])

    def _decode(self, encoded: list[bytes]) -> list[bytes]:
        counts = np.array([len(e) // 4 for e in encoded])
        out = [b""] * len(encoded)
        if counts.sum():
            self.con.register("tokens", pa.table({
                "doc": np.repeat(np.arange(len(encoded), dtype=np.int32), counts),
                "pos": np.arange(counts.sum(), dtype=np.int32),
                "id": np.frombuffer(b"".join(encoded), "<u4").astype(np.int32),
            }))
            for doc, text in zip(*self.con.sql(DECODE).to_arrow_table().to_pydict().values()):
                out[doc] = text.encode("latin-1")
            self.con.unregister("tokens")
        return out


def coder(content: bytes, pattern: str) -> Coder:
    """The process's coder for a vocabulary: made once, used by all its tasks."""
    return process_memory(("byte_bpe", hash(content), pattern), lambda: Coder(content, pattern))


def encode(documents: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns: the key, ``ids`` (binary: little-endian unsigned 32-bit integers) and ``n_tokens``."""
    content = Path(vocabulary).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(content, pattern)
        for part in slices(batches, 1, SLICE_BYTES):
            ids = words.encode(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["key", "ids"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    coded = map_texts(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, ids binary")
    return coded.select(F.col("key").alias(key), "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"))


def decode(encoded: DataFrame, vocabulary: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the bytes that the ids stand for. No ids: no bytes; ids outside the vocabulary stand for nothing."""
    content = Path(vocabulary).read_bytes()
    names = [c for c in encoded.columns if c != "decoded"]
    rows = encoded.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(content, pattern)
        for part in slices(batches, names.index(ids), SLICE_BYTES):
            texts = words.decode([x or b"" for x in part.column(names.index(ids)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded binary"
    return map_texts(rows, run, schema)


def encode_and_decode(documents: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` of its ids in one task: the key, ``n_tokens``, ``ids`` and ``decoded``."""
    content = Path(vocabulary).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(content, pattern)
        for part in slices(batches, 1, SLICE_BYTES):
            ids = words.encode(part.column(1).to_pylist())
            arrays = [part.column(0), pa.array(ids, pa.binary()), pa.array(words.decode(ids), pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "ids", "decoded"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    coded = map_texts(rows, run, f"key {rows.schema['key'].dataType.simpleString()}, ids binary, decoded binary")
    return coded.select(F.col("key").alias(key), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


def digests(documents: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the bytes decoded from them."""
    coded = encode_and_decode(documents, vocabulary, pattern, key)
    return coded.select(
        key, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
