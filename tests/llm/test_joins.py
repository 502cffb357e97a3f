"""Operators across documents and the pipeline, against brute force."""

import random
import zlib

import numpy as np
import pytest

import compare
import corpus_pipeline
from eventide.llm import components, decontaminate, line_dedup, ngram_join, queries, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, class string, n string, entry int, runs string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "c", None, 1, None) for i, t in texts], SCHEMA)


def shingles(text, size=3):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_components(texts, size=3, percent=90):
    sets = [shingles(t, size) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(texts):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(texts))


def near_copies(seed, families=8, copies=14, length=70, common=True):
    """Families of edited copies, chains of copies of copies, a passage that all texts share, short texts, nothing."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = r.choices(vocabulary, k=25)
    texts = []
    for _ in range(families):
        base = r.choices(vocabulary, k=length) + (passage if common else [])
        last = base
        for _ in range(copies):
            new = list(r.choice([base, last]))
            for _ in range(r.randrange(4)):
                p = r.randrange(len(new))
                new[p : p + 1] = r.choice([[], [r.choice(vocabulary)], [new[p], r.choice(vocabulary)]])
            texts.append(" ".join(new))
            last = new
    texts += ["", " \n", None, "one", "One", "one two", "one two three", "ONE  two\tthree", "a b c d e f g h i j", "a b c d e f g h i", texts[0], texts[0].upper()]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("frequent,block,seed", [(4, 256, 1), (50, 4, 2), (0, 3, 3)])
def test_join_equals_brute_force(spark, monkeypatch, frequent, block, seed):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "WORD_COUNT", 8 if frequent == 4 else 60 if frequent else 1)
    texts = near_copies(seed)
    got = ngram_join.join_components(frame(spark, texts)).collect()
    assert sorted(map(tuple, got)) == brute_components(texts)


def test_prefixes_of_linked_sets_meet():
    r = random.Random(11)
    frequent = np.array(sorted(r.sample(range(0, 500), 200)), np.int64)
    checked = 0
    for _ in range(4000):
        n = r.randrange(9, 200)
        a = r.sample(range(-500, 500), n)
        b = set(a) - set(r.sample(a, r.randrange(0, 1 + n // 12))) | set(r.sample(range(-500, 500), r.randrange(0, 1 + n // 14)))
        a = set(a)
        if 100 * len(a & b) >= 90 * len(a | b):
            checked += 1
            (sa, pa_), (sb, pb) = (ngram_join.signatures(np.array(sorted(x), np.int64), frequent) for x in (a, b))
            assert set(sa.tolist()) & set(sb.tolist())
            assert not (pa_ and pb) or ngram_join.may_link(sa, len(a), sb, len(b), 90)
            n, plain = np.array([len(a), len(b)]), np.array([pa_, pb])
            assert ngram_join.possible(n, plain, [sa, sb], np.array([0, 1]), 90)[0, 1]
    assert checked > 1000


def test_token_sets_equal_shingles(monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 64)
    texts = [t for _, t in near_copies(5, families=2, copies=5)] + ["x" * 300, "a " * 400 + "b" * 90 + " c", "é\u00a0a b\x1cc d\x0be", None, ""]
    table = ngram_join.word_table(ngram_join.word_hashes(b"w1 w2 w3 a b")[0])
    sets = ngram_join.token_sets(texts, table=table)
    for t, s in zip(texts, sets):
        assert len(s) == len(shingles(t)) and s.tolist() == sorted(set(s.tolist()))
        alone = ngram_join.token_sets([t], table=table)[0]
        assert alone.tolist() == s.tolist()
    for i, s in enumerate(sets):
        for j in range(i):
            assert len(set(s.tolist()) & set(sets[j].tolist())) == len(shingles(texts[i]) & shingles(texts[j]))


def test_join_repeated_keys_null_keys_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(40))
    texts = [(7, text), (7, text), (3, text), (None, text), (5, None), (5, "alone here now"), (None, None)]
    got = ngram_join.join_components(frame(spark, texts)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(7, 38, 3), (7, 38, 3), (3, 38, 3), (None, 38, 3), (5, 0, 5), (5, 1, 5), (None, 0, None)]))
    assert ngram_join.join_components(frame(spark, [])).count() == 0
    kept = ngram_join.keep_first(frame(spark, texts))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "5", "5", "None", "None"] and kept.columns == ["doc_id", "text", "class", "n", "entry", "runs"]


@pytest.mark.parametrize("frequent,seed", [(4, 4), (0, 5)])
def test_pipeline_join_links_copies_with_added_text(spark, monkeypatch, frequent, seed):
    monkeypatch.setattr(ngram_join, "WORD_COUNT", 8 if frequent else 1)
    texts = near_copies(seed, families=5, copies=10)
    r = random.Random(seed)
    base = [f"b{r.randrange(400)}" for _ in range(100)]
    texts += [(len(texts), " ".join(base)), (len(texts) + 1, " ".join(base + [f"n{i}" for i in range(18)]))]
    sets = []
    for _, t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set())
    least = list(range(len(texts)))
    for _ in texts:  # the smallest number spreads along links until nothing changes
        new = [min([least[i], *(least[j] for j, y in enumerate(sets) if x and y and 100 * len(x & y) >= 80 * len(x | y))]) for i, x in enumerate(sets)]
        if new == least:
            break
        least = new
    got = sorted(r.doc_id for r in corpus_pipeline.join_near_copies(spark, frame(spark, texts), SF).collect())
    assert got == [i for i, x in enumerate(least) if i == x] and texts[-1][0] not in got and texts[-2][0] in got


def test_join_equals_sql(spark):
    problem, _ = compare.compare(compare.connect(SF), queries.QUERIES["op1_ngram_join"](spark, SF), queries.ORACLES["op1_ngram_join"])
    assert problem is None, problem


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(25)] + [(0, 0), (None, 3)]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    least = {x: x for p in pairs for x in p if x is not None and p[0] != p[1] and None not in p}
    for _ in range(60):
        for a, b in pairs:
            if a in least and b in least and a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert got == least
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_windows(text, words=line_dedup.RUN_WORDS):
    lines = [x.strip() for x in (text or "").split("\n") if x.split()]
    found = []
    for i in range(len(lines)):
        n = 0
        for j in range(i, len(lines)):
            n += len(lines[j].split())
            if n >= words:
                found.append("\n".join(lines[i : j + 1]))
                break
    return found


def passages(seed=6):
    r = random.Random(seed)
    line = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.randrange(900)}" for _ in range(n))
    shared = [[line(60)], [line(12) for _ in range(6)], [line(3) for _ in range(30)], [line(30), line(30)]]
    texts = []
    for i in range(40):
        own = [line(r.randrange(1, 20)) for _ in range(r.randrange(1, 8))]
        for p in r.sample(shared, r.randrange(0, 3)):
            own[r.randrange(len(own) + 1):0] = p
        texts.append("\n".join(own))
    texts += [texts[3], texts[4] + "\n" + texts[4], "\n".join([line(9)] * 40), "", None, "\n\n", line(200) + "\n" + line(5)]
    return list(enumerate(texts))


def test_line_dedup_leaves_no_repeated_run(spark):
    texts = passages()
    docs = frame(spark, texts + [(None, texts[0][1])])
    out = line_dedup.dedup(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect() if r.doc_id is not None))
    assert [k for k, _ in got] == [k for k, _ in texts]
    seen, first = set(), {}
    for (k, before), (_, after) in zip(texts, got):
        kept = [x for x in (after or "").split("\n") if x]
        assert len([x for x in kept if x.split()]) <= len([x for x in (before or "").split("\n") if x.split()])
        it = iter((before or "").split("\n"))
        assert all(x in it for x in kept)  # lines in order, none new
        for w in brute_windows(after):
            assert w not in seen
            seen.add(w)
        for line in (before or "").split("\n"):
            first.setdefault(line.strip(), k)
    left = {line.strip() for _, t in got for line in (t or "").split("\n")}
    assert {x for x in first if len(x.split()) >= 25} <= left  # every long line stands somewhere
    assert got[0][1] == texts[0][1] and got[-1][1] == texts[-1][1]
    assert [t for k, t in got if texts[k][1] in (None, "", "\n\n")] == [t for _, t in texts if t in (None, "", "\n\n")]


def test_line_dedup_exact_copies_and_repeats(spark):
    long = "\n".join(f"line {i} " + "x " * 20 for i in range(5))
    docs = frame(spark, [(1, long), (2, long), (2, long), (3, "own words only " * 5 + "\n" + long), (4, "few words")])
    got = {}
    for r in line_dedup.dedup(docs).collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {1: [long], 2: ["", ""], 3: ["own words only " * 5], 4: ["few words"]}
    assert sorted(r.doc_id for r in line_dedup.dedup(docs, drop_emptied=True).collect()) == [1, 3, 4]
    runs = line_dedup.repeated_runs(docs).collect()
    assert {(r.key, r.first_line, r.last_line, r.source_key) for r in runs} == {(2, 0, 4, 1), (3, 1, 5, 1)}
    assert line_dedup.dedup(frame(spark, [])).count() == 0


def test_winnowing_guarantee():
    r = random.Random(1)
    for _ in range(300):
        run = [(r.randrange(2**63), r.randrange(1, 40)) for _ in range(r.randrange(1, 60))]
        if sum(w for _, w in run) < line_dedup.RUN_WORDS:
            continue
        a, b = ([(r.randrange(2**63), r.randrange(1, 40)) for _ in range(r.randrange(0, 20))] for _ in range(2))
        prints = [set(line_dedup.fingerprints([h for h, _ in x + run], [w for _, w in x + run]).values()) for x in (a, b)]
        assert prints[0] & prints[1]


def brute_word_runs(text, n=line_dedup.RUN_WORDS):
    words = (text or "").split()
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def test_line_dedup_finds_passages_inside_lines(spark):
    r = random.Random(8)
    line = lambda n: " ".join(f"{r.choice('äbcdefgh')}{r.randrange(900)}" for _ in range(n))
    shared = [line(50).split(" ") for _ in range(3)] + [line(90).split(" ")]
    texts, planted = [], []
    for i in range(24):
        p = shared[i % 4]
        cut = r.randrange(1, len(p))
        inside = " ".join(p) if i % 3 else " ".join(p[:cut]) + "\n \n" + "  ".join(p[cut:])
        before, after = line(r.randrange(0, 30)), line(r.randrange(0, 30))
        texts.append(f"{line(6)}\n{before} {inside} {after}\nlast {line(4)}")
        planted.append((before.split(), after.split(), p))
    texts.append(" ".join(shared[0]) + " " + line(3))
    docs = frame(spark, list(enumerate(texts)))
    got = {x.doc_id: x.text for x in line_dedup.dedup(docs).collect()}
    assert all(got[i] == texts[i] for i in range(4))
    for i, (before, after, p) in enumerate(planted):
        if i >= 4:
            own = texts[i].split("\n")
            assert got[i].split() == own[0].split() + before + after + own[-1].split()
    assert got[24].split() == texts[24].split()[50:]
    found = line_dedup.repeated_runs(docs).collect()
    assert len({(x.key, x.first_word, x.last_word) for x in found}) == 21
    for x in found:
        mine, theirs = texts[x.key].split(), texts[x.source_key].split()
        n = x.last_word - x.first_word + 1
        assert mine[x.first_word : x.last_word + 1] == theirs[x.source_word : x.source_word + n] and n >= 50
        for text, word, at in ((texts[x.key], x.first_word, x.first_line), (texts[x.key], x.last_word, x.last_line), (texts[x.source_key], x.source_word, x.source_line)):
            lines = [i for i, y in enumerate([y for y in text.split("\n") if y.split()]) for _ in y.split()]
            assert lines[word] == at
    seen = set()
    for i in range(25):
        own = brute_word_runs(got[i])
        assert not seen & set(own)
        seen |= set(own)


def test_line_dedup_finds_passages_around_a_line_that_stood_alone(spark):
    r = random.Random(9)
    line = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.randrange(900)}" for _ in range(n))
    texts, pairs = [], []
    for _ in range(12):  # in some of them the window's minimum lies in the line that stood alone
        alone, x, y = line(40), line(15), line(15)
        at = len(texts)
        texts += [f"{line(15)}\n{alone}\n{line(15)}", f"{line(4)}\n{x}\n{alone}\n{line(4)}", f"{line(5)} {x}\n{alone} {line(5)}", f"{line(7)}\n{alone} {y}\n{line(4)}", f"{alone}\n{y} {line(9)}"]
        pairs += [(at + 1, at + 2), (at + 3, at + 4)]
    docs = frame(spark, list(enumerate(texts)))
    got = {x.doc_id: x.text for x in line_dedup.dedup(docs).collect()}
    first = {}
    for i, t in enumerate(texts):  # every word of a run of 50 words that stood earlier goes
        words, gone = t.split(), set()
        for a, w in enumerate(brute_word_runs(t)):
            if first.setdefault(w, i) < i:
                gone |= set(range(a, a + 50))
        kept = [x for j, x in enumerate(words) if j not in gone]
        it = iter(kept)
        assert all(x in it for x in got[i].split())
    for _, j in pairs:
        assert len(got[j].split()) == len(texts[j].split()) - 55


@pytest.fixture(scope="module")
def model(spark):
    sf = "/root/testdata/sf0.1"
    return toxicity.train(queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels"))


def test_toxicity_held_out(spark, model):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in queries.table(spark, sf, "labels").collect()}
    rows = [r for r in toxicity.score(queries.table(spark, sf, "documents"), model).collect() if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    test = [(r.predicted, labels[r.doc_id], r.score) for r in rows if r.held_out]
    assert all(0 <= s <= 1 and p == (s >= 0.7) for p, _, s in test)
    caught, toxic = sum(p and y for p, y, _ in test), sum(y for _, y, _ in test)  # half of the toxic documents of the other languages have no insult
    assert caught >= 0.5 * toxic and sum(p and not y for p, y, _ in test) <= 0.012 * len(test)


def test_toxicity_tolerates_inserted_letters(model):
    score = lambda w: float(model.score(model.margins([toxicity.letters(w)]))[0])
    assert min(map(score, ["idiot", "i-d.i_o*t", "stupid"])) > 0.7 > max(map(score, ["the", "thing", "house"]))
    assert "idiot" in toxicity.tokens("you i d i o t there")


def test_toxicity_cases(spark, model):
    docs = frame(spark, [(1, None), (2, ""), (3, "a b"), (None, "such an idiot"), (4, "fine " * 50_000 + "idiot"), (5, "ok"), (5, "ok")])
    got = {(r.doc_id): r for r in toxicity.score(docs, model).collect()}
    assert got[1].score == got[2].score == min(r.score for r in got.values()) and got[4].predicted == got[None].predicted == 1
    assert sorted(str(r.doc_id) for r in toxicity.remove_toxic(docs, model).collect()) == ["1", "2", "3", "5", "5"]
    assert toxicity.score(frame(spark, []), model).count() == 0
    assert toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert [r.score for r in toxicity.score(docs, None).collect()] == [0.0] * 7


def test_kernel_equals_its_definition():
    import itertools

    def vector(word):
        out = {}
        for i, j, k in itertools.combinations(range(len(word)), 3):
            if k - i < toxicity.SPAN:
                out[word[i] + word[j] + word[k]] = out.get(word[i] + word[j] + word[k], 0) + toxicity.DECAY ** (k - i + 1)
        norm = sum(v * v for v in out.values()) ** 0.5
        return {u: v / norm for u, v in out.items()}

    words = ["idiot", "idioot", "banana", "abcabcabcabc", "xyz"]
    got = toxicity.kernel(words, words)
    for i, a in enumerate(map(vector, words)):
        for j, b in enumerate(map(vector, words)):
            assert abs(got[i, j] - sum(v * b.get(u, 0) for u, v in a.items())) < 1e-9


def test_pipeline_equals_brute_force_stage_by_stage(spark):
    import hashlib

    import public_tokenizers
    import tiktoken

    from eventide.llm.byte_bpe import read_ranks
    from eventide.session import stage

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "byte_bpe"]
    docs = queries.table(spark, SF, "documents")
    columns, ins, outs = docs.columns, [], []
    for name, f in corpus_pipeline.STAGES:
        ins.append({r.doc_id: r for r in docs.collect()})
        docs = stage(f(spark, docs, SF), name)
        if name != "byte_bpe":
            assert docs.columns == columns
        outs.append({r.doc_id: r for r in docs.collect()})
    first = queries.table(spark, SF, "documents")
    scored = toxicity.score(first, toxicity.train(first, queries.table(spark, SF, "labels"))).collect()
    assert ins[0].keys() - outs[0].keys() == {r.doc_id for r in scored if r.predicted} != set()
    seen = {}
    for k in sorted(ins[1]):  # exactly the words of runs that stood earlier go, and documents that have no others
        words, gone = ins[1][k].text.split(), set()
        for a, w in enumerate(brute_word_runs(ins[1][k].text)):
            if seen.setdefault(w, (k, a)) < (k, a):
                gone |= set(range(a, a + line_dedup.RUN_WORDS))
        left = [w for j, w in enumerate(words) if j not in gone]
        assert (outs[1][k].text.split() if k in outs[1] else []) == left and (k in outs[1]) == (bool(left) or not gone)
    near = [(k, r.text) for k, r in ins[2].items()]
    kept = {k for k, _, c in brute_components(near, corpus_pipeline.NEAR_SHINGLE, corpus_pipeline.NEAR_PERCENT) if k == c}
    assert outs[2].keys() == kept
    bench = [decontaminate.plain(r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    dirty = {k for k, r in ins[3].items() if any(b.strip() in decontaminate.plain(r.text) for b in bench)}
    assert ins[3].keys() - outs[3].keys() == dirty
    ranks = read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for k, r in outs[4].items():
        ids = np.array(e.encode_ordinary(ins[4][k].text), "<u4").tobytes()
        assert bytes(r.ids) == ids and r.ids_sha256 == hashlib.sha256(ids).hexdigest() and r.decoded_sha256 == hashlib.sha256(ins[4][k].text.encode()).hexdigest()
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {k: r.ids_sha256 for k, r in outs[4].items()}


def test_pipeline_stages_take_odd_and_empty_tables(spark):
    from eventide.session import stage

    schema = queries.table(spark, SF, "documents").schema
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no key here", None, None, None), (4, "x " * 40_000, "de", "s", 1),
           (5, "same words in both", "en", "s", 2), (5, "same words in both", "en", "s", 2), (6, "\n\n \n", "fr", None, 3)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for name, f in corpus_pipeline.STAGES:
            docs = stage(f(spark, docs, SF), name)
        assert sorted(str(r.doc_id) for r in docs.collect()) == sorted(str(r[0]) for r in rows)
        assert all(r.n_tokens == len(r.ids) // 4 for r in docs.collect())
