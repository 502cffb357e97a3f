"""Counts of word lists that are tables, of many terms, in whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions import text as X

#: The automaton of all terms is held by every task; a table of more terms than this is refused.
MAX_TERMS = 2_000_000


def automaton(lexicon: DataFrame, max_terms: int = MAX_TERMS) -> tuple:
    """(automaton, names): one machine over the terms of all lexicons of a table (lexicon, term), built once.

    Terms are compared as token sequences, as texts are; null terms and terms without a token are left out, repeated ones
    count once.
    """
    import ahocorasick

    norm = F.trim(F.regexp_replace(F.lower("term"), r"[^\p{L}\p{N}]+", "  "))
    terms = lexicon.select("lexicon", norm.alias("term")).where("lexicon is not null and term <> ''").distinct()
    rows = terms.limit(max_terms + 1).collect()
    if len(rows) > max_terms:
        raise ValueError(f"a lexicon table of more than {max_terms} terms")
    names = sorted({r["lexicon"] for r in rows})
    number, owners = {n: i for i, n in enumerate(names)}, {}
    for r in rows:
        owners.setdefault(f" {r['term']} ", []).append(number[r["lexicon"]])
    machine = ahocorasick.Automaton()
    for term, of in owners.items():
        machine.add_word(term, (len(term), tuple(of)))
    machine.make_automaton()
    return machine, names


def count_hits(machine, n: int, text: str) -> list[int]:
    """Hits per lexicon: from left to right the longest term at each place, then behind it, for each lexicon by itself."""
    hits = [0] * n
    if not len(machine):
        return hits
    found = [(end - size + 1, -size, of) for end, (size, of) in machine.iter(text)]
    found.sort(key=itemgetter(0, 1))
    behind = [0] * n
    for start, size, of in found:
        for k in of:
            if start >= behind[k]:
                hits[k] += 1
                behind[k] = start - size
    return hits


def lexicon_density(df: DataFrame, keep: list[str], text: str, lexicon: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """(keep..., words, lexicon, hits, per_1000) for every row and lexicon of a table (lexicon, term).

    The automaton is broadcast once and unpacked once per process; a text is read once for all lexicons. Null and empty
    texts have no words and no hits.
    """
    machine, names = automaton(lexicon, max_terms)
    sent = df.sparkSession.sparkContext.broadcast(machine)
    tokens = X.normalised(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(*keep, X.words(tokens).cast("int").alias("_words"), tokens.alias("_text"))
    kept = rows.select(*keep).schema
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.array([count_hits(sent.value, width, t) for t in batch.column(len(keep) + 1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*kept.names, "words", "hits"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    counted = rows.mapInArrow(run, f"{schema}words int, hits array<int>")
    each = F.arrays_zip(F.array(*[F.lit(n) for n in names]).cast("array<string>").alias("lexicon"), F.col("hits"))
    long = counted.select(*keep, "words", F.explode(each).alias("e")).select(*keep, "words", "e.lexicon", "e.hits")
    return long.withColumn("per_1000", F.when(F.col("words") > 0, F.col("hits") * 1000 / F.col("words")).otherwise(F.lit(0.0)))
