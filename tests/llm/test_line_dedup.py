"""Line dedup against brute force: exactly the words of runs that stand at an earlier place go."""

import random

import pytest

from eventide.llm import line_dedup

SCHEMA = "doc_id long, text string, key string, digest string, mark long, words string, runs string, n long"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(k, t, "k", "d", 1, "w", "r", 0) for k, t in rows], SCHEMA).repartition(parts)


def brute(texts):
    """Places of the words that go, per text; texts in order of their keys, without equal keys."""
    first, gone = {}, []
    for i, t in enumerate(texts):
        words, out = (t or "").split(), set()
        for a in range(len(words) - line_dedup.RUN_WORDS + 1):
            run = tuple(words[a : a + line_dedup.RUN_WORDS])
            if first.setdefault(run, (i, a)) < (i, a):
                out |= set(range(a, a + line_dedup.RUN_WORDS))
        gone.append(out)
    return gone


def corpus(seed, vocabulary, documents=30):
    r = random.Random(seed)
    words = lambda n: [f"w{r.randrange(vocabulary)}" for _ in range(n)]
    pool, texts = [words(r.randrange(20, 120)) for _ in range(6)], []
    for _ in range(documents):
        parts = []
        for _ in range(r.randrange(1, 6)):
            p = r.choice([*pool, *[words(r.randrange(0, 40))] * 3])
            parts += p[r.randrange(0, max(1, len(p) - 30)) :] if r.random() < 0.5 else p
        texts.append("".join(p + r.choice(["\n", " ", "  ", "\n\n", "\t"]) for p in parts))
    return [*texts, texts[0], texts[3], texts[3] + texts[5], "", None]


@pytest.mark.parametrize("vocabulary", [2, 30, 500])
def test_deleted_words_equal_brute_force(spark, vocabulary):
    texts = [t for seed in range(3) for t in corpus(seed, vocabulary)]
    gone = brute(texts)
    docs = frame(spark, [*enumerate(texts), (None, texts[0])])
    out = line_dedup.dedup(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got.pop(None) == texts[0] and len(got) == len(texts)
    for i, t in enumerate(texts):
        words = (t or "").split()
        assert (got[i] or "").split() == [w for j, w in enumerate(words) if j not in gone[i]], i
    for r in line_dedup.repeated_runs(docs).collect():
        mine, theirs, n = texts[r.key].split(), texts[r.source_key].split(), r.last_word - r.first_word + 1
        assert n >= line_dedup.RUN_WORDS and mine[r.first_word : r.last_word + 1] == theirs[r.source_word : r.source_word + n]
        assert (r.source_key, r.source_word) < (r.key, r.first_word)


def test_text_of_a_million_words_repetitive_and_not(spark):
    r = random.Random(4)
    many = " ".join(f"w{r.randrange(10**6)}" for _ in range(10**6))
    same = "x " * 10**6
    got = {x.doc_id: x.text for x in line_dedup.dedup(frame(spark, [(1, many), (2, same), (3, "own " + many), (4, "y " + same)])).collect()}
    assert got[1] == many and got[3].split() == ["own"] and got[4].split() == ["y"]
    assert got[2].split() == ["x"]  # every further run overlaps the first


def test_hot_copies_and_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(i, long) for i in range(300)] + [(7, long)] * 300 + [(1_000, "before " + long)]
    got = line_dedup.dedup(frame(spark, rows, 20), drop_emptied=True).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(0, long), (1_000, "before")]
