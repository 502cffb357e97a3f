"""Lexicon tables against the alternations of fixed word lists, and tables of many overlapping terms."""

import random
import re

import pytest
from pyspark.sql import functions as F

from eventide.operators import documents, lexicons
from eventide.plans.q_text import LEXICONS

WORDS = [f"w{i}" for i in range(60)]


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain(text, known):
    """Hits of one lexicon, of terms as tuples of tokens: at each token the longest term that stands there."""
    words, at, hits = tokens(text), 0, 0
    longest = max(map(len, known), default=0)
    while at < len(words):
        n = next((n for n in range(min(longest, len(words) - at), 0, -1) if tuple(words[at : at + n]) in known), 0)
        hits, at = hits + (n > 0), at + max(1, n)
    return hits


def test_a_table_equals_the_alternations(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, None), (-2, ""), (-3, "OF THE of the, of; the -- in"), (-4, "of of the the")], "doc_id long, text string"))
    terms = spark.createDataFrame([(k, t) for k, v in LEXICONS.items() for t in [*v, *v, v[0].upper()]] + [("risk", None), ("risk", " -- "), (None, "x")], "lexicon string, term string")
    order = ["doc_id", "lexicon"]
    got = lexicons.lexicon_density(docs, ["doc_id"], "text", terms).orderBy(order).collect()
    want = documents.lexicon_density(docs.fillna("", ["text"]), ["doc_id"], "text", LEXICONS).orderBy(order).collect()
    assert len(got) == docs.count() * 3 and [(r.doc_id, r.words, r.lexicon, r.hits, r.per_1000) for r in got] == [(r.doc_id, r.words, r.lexicon, r.hits, r.per_1000) for r in want]


def test_a_hundred_thousand_overlapping_terms(spark):
    r = random.Random(3)
    phrase = lambda: " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 6)))
    terms = sorted({(r.choice("ab"), phrase()) for _ in range(200_000)})
    texts = [" ".join(r.choice([*WORDS, "other"]) for _ in range(r.randrange(0, 300))) for _ in range(60)] + ["w1 " * 5000]
    got = lexicons.lexicon_density(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), ["i"], "text", spark.createDataFrame(terms, "lexicon string, term string")).collect()
    of = {k: {tuple(tokens(t)) for n, t in terms if n == k} for k in "ab"}
    assert len(terms) > 100_000 and len(got) == 2 * len(texts)
    for row in got:
        assert row.hits == plain(texts[row.i], of[row.lexicon]), row


def test_no_terms_and_too_many(spark):
    docs = spark.createDataFrame([(1, "a b")], "i int, text string")
    none = spark.createDataFrame([], "lexicon string, term string")
    assert lexicons.lexicon_density(docs, ["i"], "text", none).collect() == []
    some = spark.range(20).select(F.lit("x").alias("lexicon"), F.concat(F.lit("t"), "id").alias("term"))
    assert lexicons.lexicon_density(docs.where("false"), ["i"], "text", some).collect() == []
    with pytest.raises(ValueError):
        lexicons.automaton(some, max_terms=19)
