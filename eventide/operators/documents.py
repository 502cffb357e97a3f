"""Text features of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions import text as X
from eventide.operators.ordering import first_per_key


def lexicon_density(docs: DataFrame, key: list[str], text: str, lexicons: dict[str, list[str]]) -> DataFrame:
    """(key..., words, lexicon, hits, per_1000): one projection, no shuffle."""
    counts = X.with_value(X.normalised(F.col(text)), lambda t: F.struct(
        X.words(t).alias("words"), *[X.hits(t, terms).alias(name) for name, terms in lexicons.items()]))
    counted = docs.select(*key, counts.alias("c")).select(*key, "c.*")
    long = counted.unpivot([*key, "words"], list(lexicons), "lexicon", "hits")
    return long.withColumn("per_1000", F.when(F.col("words") > 0, F.col("hits") * 1000 / F.col("words")).otherwise(F.lit(0.0)))


def novelty_vs_prior(docs: DataFrame, symbol: str, text: str, order: str, terms: list[str]) -> DataFrame:
    """Terms of each event that its symbol's previous event did not have; NULL for the first event.

    One row per (symbol, year, quarter) remains before the window, so a symbol's window is bounded
    by the calendar.
    """
    key = [symbol, "quarter", "year"]
    present = docs.select(*key, order, X.terms_present(X.normalised(F.col(text)), terms).alias("terms"))
    events = first_per_key(present, key, [F.col(order)])
    prior = F.lag("terms").over(Window.partitionBy(symbol).orderBy("year", "quarter"))
    return events.select(*key, F.size("terms").alias("n_terms"),
                         F.when(prior.isNotNull(), F.size(F.array_except("terms", prior))).alias("n_new"))
