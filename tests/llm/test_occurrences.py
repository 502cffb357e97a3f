"""Benchmark passages against the alignment of every item with every whole text."""

import random

import numpy as np

from eventide.llm import decontaminate

SCHEMA = "doc_id long, text string, item_id string, item string"


def least_edits(item, text):
    """Fewest edits between the item and any part of the text, by the full table."""
    row = np.zeros(len(text) + 1, np.int64)
    places = np.arange(len(text) + 1)
    letters = np.frombuffer(text, np.uint8)
    for i, c in enumerate(item, 1):
        new = np.r_[i, np.minimum(row[:-1] + (letters != c), row[1:] + 1)]
        row = np.minimum.accumulate(new - places) + places
    return int(row.min())


def edited(r, text, n):
    for _ in range(n):
        at = r.randrange(len(text))
        text = r.choice([text[:at] + text[at + 1 :], text[:at] + r.choice("abcde ") + text[at:], text[:at] + r.choice("abcde ") + text[at + 1 :]])
    return text


def test_occurrences_equal_alignment_of_everything(spark):
    r = random.Random(12)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(n))
    items = [prose(n) for n in (4, 6, 12, 12, 25, 40)] + ["x " * 20, "ab" * 30]
    texts = []
    for i in range(120):
        own, item = prose(r.randrange(0, 60)), items[i % len(items)]
        budget = int(decontaminate.EDITS * len(decontaminate.plain(item)))
        texts.append(f"{own} {edited(r, item, r.randrange(0, 2 * budget + 2)).upper()} {prose(r.randrange(0, 20))}")
    texts += ["x " * 300, "ab" * 200, "", None]
    docs = spark.createDataFrame([(i, t, "k", "k") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    bench = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(items)], "item_id string, text string")
    got = {}
    for o in decontaminate.occurrences(docs, bench).collect():
        got[o.doc_id, o.item_id] = min(got.get((o.doc_id, o.item_id), 10**9), o.edits)
    want = {}
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            a, b = decontaminate.plain(item).strip(), decontaminate.plain(t)  # blanks around an item don't count
            if t and len(a) >= decontaminate.MIN_BYTES and (n := least_edits(a, b)) <= int(decontaminate.EDITS * len(a)):
                want[i, f"i{j}"] = n
    assert got == want and 60 < len(want) < len(texts) * len(items) / 2
