"""Merkle manifest, quality classifier and fill-in-middle, against brute force, exact round trips and held-out rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import fim, merkle, quality_model, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, parent string, key string, pos long, form string, score double"


def row(i, text, lang="en", source="s", n=3):
    return (i, text, lang, source, n, "x", "y", "z", 7, "f", 0.5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- Merkle manifest -----------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lowered(t):
    return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def climb(nodes):
    """Root of a list of digests, and the siblings (left, right) of each level for every one of them."""
    paths, at, where = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(at) > 1:
        for i, w in enumerate(where):
            low = w // 8 * 8
            paths[i].append(("".join(at[low:w]), "".join(at[w + 1 : low + 8])))
        at = [sha(*at[i : i + 8]) for i in range(0, len(at), 8)]
        where = [w // 8 for w in where]
    return at[0], paths


def brute_manifest(rows):
    leaf = lambda r, t: sha(*map(part, (r[0], r[3], r[2], r[4], t)))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf(r, r[1]), leaf(r, lowered(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else None))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    ends = {g: climb([x[1] for x in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for g in order}
    root, tops = climb([ends[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        for (key, own, tampered), path in zip(sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1])), ends[g][1]):
            at = tampered or own
            for left, right in path + top:
                at = sha(left, at, right)
            out.append((key, own, ends[g][0], root, sha(*[a + b for a, b in path + top]), at, at == root))
    return out


def manifest(df):
    found = merkle.verified(merkle.manifest(df))
    return [tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def test_manifest_equals_brute_force(spark):
    r = random.Random(3)
    data = [row(i, r.choice([None, "", "Ab\nÉ", "low", "X" * 5000]), lang, r.choice([None, "s|1", "é"]), r.choice([None, 0, -5]))
            for lang, size in ((None, 9), ("de", 1), ("en", 70), ("es", 65), ("fr", 8), ("Ü", 2), ("a", 513), ("b", 1), ("c", 1), ("", 3)) for i in r.sample(range(10**9), size)]
    data += data[:4] + [row(None, "No key", "en"), row(None, None, None), row(5, "Same key", "en"), row(5, "same key", "en")]
    r.shuffle(data)
    got = manifest(spark.createDataFrame(data, SCHEMA).repartition(7))
    want = brute_manifest(data)
    full = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted(got, key=full) == sorted(want, key=full)
    assert {x[-1] for x in got} == {True, False}


def test_manifest_of_one_leaf_one_group_and_nothing(spark, empty):
    assert manifest(empty) == []
    one = [row(8, "A")]
    assert manifest(spark.createDataFrame(one, SCHEMA)) == brute_manifest(one)
    group = [row(i, "T", "en") for i in range(17)]
    assert sorted(manifest(spark.createDataFrame(group, SCHEMA))) == sorted(brute_manifest(group))


# --- fill in the middle -----------------------------------------------------------------------------------------

ODD = ["", " ", "a", "ab", "é", "🙂🙂", "word word\nword", "<P>", "a<S>b", "x<M", "<", "<S<P", "a" * 5000, "é" * 3000, "日本 text " * 900, "\x00\r\n\tz", "aÉb",
       "a" * 1024 + "é" + "b" * 1024, "." * 2048, "w " * 50_000]


def brute_fim(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = [int(hashlib.sha256(f"1:{'-' if key is None else key}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_brute_force_and_restores(spark, empty):
    r = random.Random(5)
    made = ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(97, 123), r.randrange(0x80, 0x2FFF), r.randrange(0x1F300, 0x1F600)])) for _ in range(r.randrange(1, 4000))) for _ in range(60)]
    data = [row(i, t) for i, t in enumerate([*ODD * 3, *made])] + [row(1, "again"), row(1, "again"), row(None, "no key"), row(77_777, None)]
    got = fim.restored(fim.transform(spark.createDataFrame(data, SCHEMA).repartition(3))).collect()
    plain = lambda x: (x[0] is not None, *map(str, x))
    assert sorted([tuple(x)[:6] for x in got], key=plain) == sorted([brute_fim(d[0], d[1]) for d in data], key=plain)
    texts = {(d[0], d[1] or "") for d in data}
    assert {(x["doc_id"], x["restored"]) for x in got} == texts
    assert {x["form"] for x in got} == {"plain", "psm", "spm"}
    assert fim.transform(empty).collect() == []


@pytest.mark.parametrize("sizes", [[], [0], [3], [0, 0, 2, 0, 5, 1, 0], [1] * 33])
def test_descent_finds_the_block_of_every_unit(sizes):
    tree = fim.Fenwick(sizes, [2 * s for s in sizes])
    flat = [(b, u) for b, s in enumerate(sizes) for u in range(s)]
    assert tree.total == (len(flat), 2 * len(flat))
    for unit, (block, _) in enumerate(flat):
        before = sum(sizes[:block])
        assert tree.descend(unit) == (block, before, 2 * before)


# --- quality ----------------------------------------------------------------------------------------------------------


def test_counts_equal_plain_python():
    texts = ["", " \n ", "One two  two, É!!\n\nOne\nOne", "###| a1 22 b\tc", "日本語 テキスト", "x" * 3000 + " y", *ODD]
    got = quality_model.counts(texts)
    symbols, space = "#*$%&|<>@^~_=+\\{}[]/`", "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
    for t, g in zip(texts, got):
        words, lines = [w for w in re.split(f"[{re.escape(space)}]+", t) if w], [x for x in t.split("\n") if x.strip()]
        ascii_other = sum(c.isascii() and not c.isalnum() and c not in symbols + space + ".!?" for c in t)
        want = [len(words), len(t), sum(c.isalpha() and c.isascii() or not c.isascii() for c in t), sum("A" <= c <= "Z" for c in t), sum("0" <= c <= "9" for c in t),
                sum(c in ".!?" for c in t), sum(c in symbols for c in t), ascii_other, len(lines), len(lines) - len(set(lines)), len(set(t.split())),
                sum(a == b for a, b in zip(t.split(), t.split()[1:])), sum(len(w) <= 3 for w in words), sum(map(len, words)), sum(len(w) ** 2 for w in words)]
        assert g.tolist() == want, t[:40]


def test_density_equals_the_formula_with_inverse_and_determinant():
    r = np.random.default_rng(1)
    a, b = r.normal(size=(50, 4)), r.normal(size=(60, 4)) @ np.diag([1, 2, 3, 0.1])
    cov, within = np.cov(a.T, bias=True), (np.cov(a.T, bias=True) + np.cov(b.T, bias=True)) / 2
    model = quality_model.shrunk(a.mean(0), cov, within, 0.3, 0.1)
    s = 0.9 * (0.7 * cov + 0.3 * within)
    s += 0.1 * np.trace(0.7 * cov + 0.3 * within) / 4 * np.eye(4) + 1e-9 * np.eye(4)
    d = b - a.mean(0)
    want = -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1]
    assert np.allclose(model.log_density(b), want, atol=1e-9)


def test_moments_are_those_of_all_labelled_rows(spark):
    texts = [f"word{i} " * (i % 7 + 1) + "." * (i % 5) for i in range(200)]
    known = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    counted = quality_model.statistics(known).withColumn("label", (F.col("key") % 2).cast("int"))
    shares = np.full(len(quality_model.SHARES), 0.1)
    got = quality_model._moments(counted, shares)
    x = quality_model.features(quality_model.counts(texts), shares)
    for k in (0, 1):
        n, mean, cov = got[k]
        assert n == 100 and np.allclose(mean, x[k::2].mean(0)) and np.allclose(cov, np.cov(x[k::2].T, bias=True), atol=1e-8)


def test_quality_on_held_out_rows(spark):
    scored = queries.QUERIES["op12_quality_classifier"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = scored.join(labels, "doc_id").collect()
    assert {r["held_out"] for r in rows} == {True, False} and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    for y, least in ((1, 0.98), (0, 0.95)):
        own = [r for r in rows if r["held_out"] and r["quality"] == y]
        assert sum(r["predicted"] == y for r in own) >= least * len(own)
    assert all((r["score"] >= 0.3) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in rows)


def test_held_out_labels_and_other_columns_dont_matter(spark):
    good = ["The quick brown fox jumps over a lazy dog and walks home.", "Nothing is better than a calm day at sea, they said."]
    bad = ["### $$$ | buy | buy | buy", "X X X X X X X X X X"]
    data = [row(i, (good if i % 2 else bad)[i // 2 % 2] + f" {i}") for i in range(400)] + [row(None, None), row(9_000, ""), row(3, good[0])]
    docs = spark.createDataFrame(data, SCHEMA)
    labels = [(i, i % 2, "k") for i in range(400)] + [(None, 1, "k"), (9_000, None, "k"), (3, 1, "k")]
    out = []
    for flip in (False, True):
        own = [(k, 1 - q if flip and k is not None and q is not None and zlib.crc32(str(k).encode()) % 5 == 0 else q, t) for k, q, t in labels]
        counted = quality_model.statistics(docs)
        model = quality_model.train(counted, spark.createDataFrame(own, "doc_id long, quality int, text string"))
        out.append(sorted(map(tuple, quality_model.score(counted, model).collect()), key=str))
    assert [x[0] for x in out[0]] == [x[0] for x in out[1]] and np.allclose([x[2] for x in out[0]], [x[2] for x in out[1]], atol=1e-5)
    assert len(out[0]) == len(data) and sum(x[3] == x[0] % 2 for x in out[0] if x[0] is not None and x[0] < 400) >= 398
    assert [x[1] for x in out[0] if x[0] is None] == [False]


def test_quality_without_rows_or_labels(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_model.score(quality_model.statistics(empty), quality_model.train(quality_model.statistics(empty), labels)).collect() == []
    counted = quality_model.statistics(spark.createDataFrame([row(1, "a")], SCHEMA))
    assert quality_model.train(counted, labels) is None
    assert [tuple(r) for r in quality_model.score(counted, None).collect()] == [(1, False, 0.5, 1)]
