"""Registered queries of this folder: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm import (bpe_count, byte_bpe, decontaminate, fim, licenses, line_dedup, line_quality, merkle, ngram_join, packing,
                          quality_model, toxicity, url_model)
from eventide.session import stage

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Context length that documents are compared with.
TOKEN_LIMIT = 2048


def query(name: str, oracle: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_ngram_join", ngram_join.oracle())
def op1_ngram_join(spark, sf_dir):
    """Components of documents whose sets of three-word shingles overlap by nine tenths."""
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


@query("op2_decontamination")
def op2_decontamination(spark, sf_dir):
    """Every place of a benchmark item in a document."""
    return decontaminate.occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_quality_rules", line_quality.oracle())
def op3_quality_rules(spark, sf_dir):
    """Line-first quality rules on every document."""
    return line_quality.assess(table(spark, sf_dir, "documents")).drop("cleaned")


@query("op4_url_filters")
def op4_url_filters(spark, sf_dir):
    """Rules and character models on every page's url."""
    return url_model.judge(table(spark, sf_dir, "pages"))


@query("op5_token_counts")
def op5_token_counts(spark, sf_dir):
    """Tokens of every document."""
    return bpe_count.with_limit(bpe_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")), TOKEN_LIMIT)


@query("op6_license_scans")
def op6_license_scans(spark, sf_dir):
    """License phrases and signatures of every document."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("found")


@query("op8_packing")
def op8_packing(spark, sf_dir):
    """Every row of the packed matrices: its documents, where their pieces begin, cumulative lengths, digests of ids and positions."""
    import public_tokenizers

    shards = packing.packed(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = packing.matrix_rows(shards)
    return rows.select(
        "shard", "row", "doc_ids", "offsets", "cu_seqlens", F.element_at("cu_seqlens", -1).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"),
    )


@query("op9_byte_bpe")
def op9_byte_bpe(spark, sf_dir):
    """Ids of every document, and the bytes that they decode to, as digests."""
    import public_tokenizers

    return byte_bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    """Toxicity of every document, learnt from labels that aren't held out."""
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


@query("op7_line_dedup")
def op7_line_dedup(spark, sf_dir):
    """Every run of words that is deleted and its lines, with the document, line and word where it stands first."""
    runs = line_dedup.repeated_runs(table(spark, sf_dir, "documents"))
    return runs.select(F.col("key").alias("doc_id"), "first_line", "last_line", F.col("source_key").alias("source_doc_id"), "source_line", "first_word", "last_word", "source_word")


@query("op11_merkle_manifest", merkle.oracle())
def op11_merkle_manifest(spark, sf_dir):
    """Leaf, subroot, root and proof of every document, and whether its leaf, partly tampered with, still folds into the root."""
    found = merkle.verified(merkle.manifest(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op12_quality_classifier")
def op12_quality_classifier(spark, sf_dir):
    """Quality of every document, learnt from labels that aren't held out."""
    counted = stage(quality_model.statistics(table(spark, sf_dir, "documents")), "statistics")
    return quality_model.score(counted, quality_model.train(counted, table(spark, sf_dir, "labels")))


@query("op13_fill_in_middle", fim.oracle())
def op13_fill_in_middle(spark, sf_dir):
    """Every document with its middle at the end, and the text rebuilt from that, as digests."""
    made = fim.restored(fim.transform(table(spark, sf_dir, "documents")))
    hashed = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashed("output").alias("output_sha256"), hashed("restored").alias("restored_sha256"))
