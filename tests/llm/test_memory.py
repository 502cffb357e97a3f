"""Memory of the training-data operators' tasks: rows come in bounded batches, and no step keeps copies of what it goes through."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from eventide.llm import batches, byte_bpe, ngram_join, toxicity


def test_tasks_get_bounded_batches(spark):
    """600 texts of 50 kB: 30 MB, which were one batch before."""
    rows = spark.range(0, 600, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("five "), 10_000).alias("text"))
    count = lambda found: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"]) for b in found)
    found = batches.map_texts(rows, count, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 600
    assert max(r["size"] for r in found) <= batches.BATCH_BYTES + 100_000


def test_repeated_values_need_no_copies():
    r = np.random.default_rng(5)
    for n in (0, 1, 3, 4, 5, 1_000):
        values = r.integers(-40, 40, n)
        found, counts = np.unique(values, return_counts=True)
        some, times = ngram_join.repeated(values.copy(), 4)
        assert some.tolist() == found[counts >= 4].tolist() and times.tolist() == counts[counts >= 4].tolist()
    values = r.integers(0, 1 << 60, 1_000_000)  # 8 MB
    tracemalloc.start()
    ngram_join.repeated(values, 4)
    assert tracemalloc.get_traced_memory()[1] < 4_000_000
    tracemalloc.stop()


def test_margins_of_many_words_are_worked_out_in_parts():
    r = np.random.default_rng(6)
    words = ["".join(map(chr, r.integers(97, 123, 6))) for _ in range(100_000)]
    model = toxicity.Model(r.normal(size=toxicity._SYMBOLS**3).astype(np.float32), -1.0, 5.0, 0.0)
    tracemalloc.start()
    found = model.margins(words)
    assert tracemalloc.get_traced_memory()[1] < 25_000_000
    tracemalloc.stop()
    assert found.tolist() == [x for i in range(0, len(words), 7_000) for x in model.margins(words[i : i + 7_000])]


def test_decoding_is_bounded_and_whole(monkeypatch):
    coder = byte_bpe.Coder(b"\n".join(b"%s %d" % (__import__("base64").b64encode(bytes([b])), b) for b in range(256)), r"\S+|\s+")
    sizes, one = [], coder._decode
    monkeypatch.setattr(byte_bpe, "DECODE_IDS", 100)
    monkeypatch.setattr(coder, "_decode", lambda some: sizes.append(sum(map(len, some)) // 4) or one(some))
    texts = ["", "x" * 250, "a b", None, *["word " * 9] * 20, "é" * 60, ""]
    assert coder.decode(coder.encode(texts)) == [(t or "").encode() for t in texts]
    assert sorted(sizes)[-2] <= 120 and len(sizes) > 5  # the longest text alone
    assert coder.decode([]) == []
