"""Operators that work on one text at a time, against libraries, SQL and brute force."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest

import compare
from eventide.llm import bpe_count, byte_bpe, decontaminate, licenses, line_quality, packing, queries, url_model

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, key string, n long, score double, runs string, n_tokens int"
ODD = ["", " ", "\n\n", "a", "a b", "é" * 700, "x" * 900, "ab" * 400, "Straße ΑΣ ΣΑΣ İ ǅ ﬁ é", "日本語 テキスト １２３ ٣", "it's I'LL we'Ve", "\x00\x1c\x85\u2028z",
       "a<|endoftext|>b <|startoftext|>", "  two  spaces \t tab\r\nline ", "🙂🙂 e\u0301", "word " * 3000]


def rows(texts):
    return [(i, t, None, "k", None, 0.5, "r", 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    made = ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(9, 14), r.randrange(0x80, 0x2FFF), r.randrange(0x1F300, 0x1F600)])) for _ in range(60)) for _ in range(40)]
    return ODD + made


@pytest.fixture(scope="module")
def odd(spark, texts):
    """Every odd text once, the first ones twice, a null text and a null key."""
    data = [*rows(texts), *rows(texts[:5]), (10_000, None, None, None, None, None, None, None), (None, "no key", "en", None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}


def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})


def test_byte_bpe_equals_library_and_decodes(odd, empty):
    e = reference()
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    got = byte_bpe.digests(odd, *args).collect()
    want = []
    for r in odd.collect():
        ids = e.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert byte_bpe.digests(empty, *args).count() == 0
    apart = byte_bpe.decode(byte_bpe.encode(odd.drop("n_tokens"), *args), *args).collect()
    assert sorted((str(r.doc_id), r.n_tokens, bytes(r.decoded)) for r in apart) == sorted((str(r.doc_id), len(e.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in odd.collect())


def test_byte_bpe_long_words_contract_many_places():
    words = byte_bpe.Coder(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    r = random.Random(2)
    texts = ["=" * 777, "a" * 500, "".join(r.choices("abcdeth", k=800)), "the" * 300, " " * 300 + "x", None]
    assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(texts)] == [reference().encode_ordinary(t or "") for t in texts]


def test_token_counts_equal_library(odd, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = bpe_count.with_limit(bpe_count.count_tokens(odd, path), 100).collect()
    want = [(r.doc_id, len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids), n > 100) for r in odd.collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe_count.count_tokens(empty, path).count() == 0


def base_figures(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))


LICENSED = ["MIT License and mit-LICENSE, Apache License\nGeneral Public License", "Licensed under CC BY-NC 4.0.", "license mit license mit license",
            "Licensed under the Apache License, Version 2.0.", "the licensee permits", "SPDX-License-Identifier: BSD-3-Clause",
            "Permission is hereby granted, free of charge, to any person obtaining a copy", "The GNU Lesser General Public License v3", "Copyright (c) 2020 X. All rights reserved."]


def test_license_base_phrases(spark, odd, empty):
    docs = odd.unionByName(spark.createDataFrame([(500 + i, t, *[None] * 6) for i, t in enumerate(LICENSED)], SCHEMA))
    got = licenses.scan(docs).collect()
    want = {r.doc_id: base_figures(r.text) for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want[r.doc_id]
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert licenses.scan(empty).count() == 0


def test_license_rules_and_suppression():
    assert len(licenses.rules()) > 200
    labels = [licenses.scan_text(t)["labels"] for t in LICENSED]
    assert labels == ["apache,gpl,mit", "cc-by-nc", "mit", "apache", "", "bsd", "mit", "gpl,lgpl", "copyright,proprietary"]
    one = licenses.detect(licenses.words_of("Licensed under the Apache License, Version 2.0."))
    assert [(x.label, x.first, x.last) for x in one] == [("apache", 0, 7)]  # the name within it is suppressed
    assert licenses.detect(licenses.words_of("the committee met")) == []


ORDINARY = [
    "This article was published by Ruby on Monday.", "A tool provided by PHP developers", "research published by MIT researchers", "available under common public pressure",
    "Most of it is covered by Python.", "The data are available by open database queries", "distributed by Apache helicopters", "a license to drive in ruby shoes is no licence of the isc kind",
    "released by Mozilla public relations", "provided under academic free will", "published under open software skies", "covered by boost software teams", "the zlib library is available by mail",
]


def test_license_names_in_ordinary_sentences():
    assert [licenses.scan_text(t)["labels"] for t in ORDINARY] == [""] * len(ORDINARY)
    named = ["licensed under the Ruby license", "provided under PHP 3.01", "published under the MIT", "available under Common Public License 1.0", "covered by the Python Software Foundation License"]
    assert [licenses.scan_text(t)["labels"] for t in named] == ["ruby", "php", "mit", "cpl", "python"]


def test_license_signatures_are_written_and_found():
    assert len(licenses.TEXTS) > 100 and len({x for *_, x in licenses.TEXTS}) == len(licenses.TEXTS)
    headers = {"THE SOFTWARE IS PROVIDED; Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
               "Redistribution... Redistributions in binary form must reproduce the above copyright notice": "bsd",
               "This library is free software; you can redistribute it and/or modify it": "lgpl", "If a copy of the MPL was not distributed with this file, You can obtain one at": "mpl",
               "You just DO WHAT THE FUCK YOU WANT TO.": "wtfpl", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software": "unlicense",
               "Use of this software is governed by the Business Source License": "busl", "This Font Software is licensed under the SIL Open Font License": "ofl"}
    for text, label in headers.items():
        assert label in licenses.scan_text(text)["labels"].split(","), text


def test_license_suppression_equals_all_pairs_and_takes_repeats():
    r = random.Random(9)
    for _ in range(300):
        found = [licenses.Found(r.choice("ab"), f := r.randrange(30), f + r.randrange(8), r.randrange(1, 5), 0.5) for _ in range(r.randrange(0, 25))]
        kept = []
        for x in sorted(found, key=lambda x: (x.priority, x.first - x.last, x.first, x.label)):
            if not any(y.first <= x.first and x.last <= y.last for y in kept):
                kept.append(x)
        assert licenses.suppressed(found) == sorted(kept, key=lambda x: (x.first, x.last))
    assert licenses.scan_text("mit license then " * 20_000)["labels"] == "mit"


def test_license_filter_drops_no_detection():
    texts = ["available under the MIT", "published under Apache 2.0", "covered by the GNU General Public", "scripts.sil.org/OFL", "eclipse.org/legal/epl", "eupl.eu",
             "mariadb.com/bsl", "GNU Library General Public License", "Creative Commons Zero license", "do what the fuck you want to public license", "zlib.net/zlib_license"]
    labels = [licenses.scan_text(t)["labels"] for t in texts]
    assert labels == ["mit", "apache", "gpl", "ofl", "epl", "eupl", "busl", "gpl,lgpl", "cc0", "wtfpl", "zlib"]
    r, rules = random.Random(4), licenses.rules()
    words = sorted({w for rule in rules for w in re.findall(r"[a-z0-9]+", rule.pattern.pattern.decode().replace("\\w", "").replace("\\d", "2"))})
    phrases = [n.replace("(?:", "").replace(")?", "").replace(")", "").split("|")[0] for f in licenses.FAMILIES for n in f[1:]] + ["licensed under the", "spdx license identifier", "license", "available by"]
    texts += [" ".join(r.choice(phrases) if r.random() < 0.7 else r.choice(words) for _ in range(r.randrange(1, 12))) for _ in range(1500)] + LICENSED
    for t in texts:
        words_ = licenses.words_of(t)
        line, found = b" ".join(words_), []
        for rule in rules:
            for m in rule.pattern.finditer(line):
                first = line[: m.start()].count(b" ")
                found.append(licenses.Found(rule.label, first, first + m.group().count(b" "), rule.priority, rule.weight))
        assert licenses.detect(words_) == licenses.suppressed(found), t


def test_quality_equals_sql(spark):
    con = compare.connect(SF)
    problem, n = compare.compare(con, queries.QUERIES["op3_quality_rules"](spark, SF), queries.ORACLES["op3_quality_rules"])
    assert problem is None, problem


def quality_figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def test_quality_figures_and_verdicts(spark, empty):
    r = random.Random(1)
    clean = "\n".join(" ".join(f"w{r.randrange(900)}" for _ in range(15)) + "." for _ in range(12))
    other = [clean, clean + "\n" + "\n".join(f"### x{i} *** y{i} &&& z{i}" for i in range(60)), clean + "\nHome | About | Contact | Login", "a b c d a b c x y z a b c", "x\nx\n\nx\n y\ny",
             "same words here " * 30, "\n".join(["We use cookies on this site to do things that nobody ever reads about."] * 15), None, *ODD[:-1]]
    docs = spark.createDataFrame([(i, t, *[None] * 6) for i, t in enumerate(other)], SCHEMA)
    got = {r.doc_id: r for r in line_quality.assess(docs).collect()}
    for i, t in enumerate(other):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == quality_figures(t), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert got[0].kept and not got[1].kept and got[2].kept and got[2].cleaned == clean and got[2].n_lost_lines == 1 and not got[6].kept
    assert line_quality.assess(empty).count() == 0


URLS = ["http://a.org/x", "http://EXAMPLE.org/es/1?q", "http://w.example.org/en/12", "http://example.org/en/2", "http://badexample.org/es/", "https://s.com/fr/a#b", "https://s.com/de/a", "ftp://x.com",
        "http://x.net/fr/", "http://org/?x", "org/x", "", None, "://", "a://b://c/d", "http://com/de/1", "http://É.net/Ä?b", "http://x.org"]


def test_url_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)] + [(None, "http://q.net/", None, None)], "page_id long, url string, host string, text string")
    got = {r.page_id: r for r in url_model.judge(pages).collect()}
    for i, u in enumerate(URLS):
        rest = u.partition("://")[2] if u and "://" in u else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = host.translate({k: k + 32 for k in range(65, 91)})
        fits = [(h + p, v) for h, p, v in url_model.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert url_model.judge(pages.where("page_id = -1")).count() == 0


def test_url_scores_equal_brute_force(spark):
    import math
    from collections import Counter

    r = random.Random(5)
    good = ["".join(r.choices("abcx/", k=r.randrange(3, 9))) for _ in range(60)]
    bad = ["".join(r.choices("cdey-", k=r.randrange(3, 9))) for _ in range(60)]
    labelled = spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in bad], "text string, allowed boolean")
    ask = ["abc", "dee", "", "zz", "abcabc/cde", good[0], bad[0]]
    got = {x.text: x.score for x in url_model.score(spark.createDataFrame([(t,) for t in ask], "text string"), *url_model.train(labelled)).collect()}

    def model(texts):
        n = Counter()
        for t in texts:
            s = url_model.START * 4 + t + url_model.END
            for i in range(4, len(s)):
                n.update(s[i - k : i + 1] for k in range(5))
        total, kinds = Counter(), Counter()
        for g, c in n.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1

        def log(t):
            s, out = url_model.START * 4 + t + url_model.END, []
            for i in range(4, len(s)):
                p = url_model.UNIFORM
                for k in range(5):
                    c = s[i - k : i]
                    if total[c]:
                        p = (n[s[i - k : i + 1]] + kinds[c] * p) / (total[c] + kinds[c])
                out.append(math.log(p))
            return out

        return log

    a, b = model(good), model(bad)
    for t in ask:
        want = sum(x - y for x, y in zip(a(t), b(t))) / (len(t) + 1)
        assert abs(got[t] - want) < 1e-6, t
    assert got["abc"] > 0 > got["dee"]


def test_url_places_and_counts_are_merged_not_broadcast(spark):
    """Places, n-grams and urls looked as small as the files they come from, so all places went through the driver; and each is shuffled once."""
    labelled = spark.createDataFrame([("abc/d", True), ("cde-", False)], "text string, allowed boolean")
    asked = spark.createDataFrame([(1, "abc"), (2, "aaaaaaaa"), (3, "")], "id long, text string")
    model = url_model.train(labelled)
    by_id = url_model.score(asked, *model, "id")
    plan = by_id._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 3
    assert "keys=[id#" in plan and "keys=[id#" not in plan.split("SortMergeJoin", 1)[1]  # no counting before the join
    by_text = {r.text: r.score for r in url_model.score(asked, *model).collect()}
    assert {r.id: r.score for r in by_id.collect()} == {i: by_text[t] for i, t in [(1, "abc"), (2, "aaaaaaaa"), (3, "")]}


def test_url_threshold_separates(spark):
    scored = spark.createDataFrame([(0.4 + i / 100, True) for i in range(20)] + [(-0.6 + i / 100, False) for i in range(20)], "score double, allowed boolean")
    assert -0.4 < url_model.calibrate(scored) < 0.4
    assert url_model.calibrate(scored.where("allowed")) == 0.0


BENCH = ["The quick brown fox jumps over the lazy dog and then it runs away from all the other dogs.", "Eine längere Prüfung über große Äpfel, die niemand je gegessen hat, steht hier.", "short one", None, ""]


def edited(text, n, seed):
    r, s = random.Random(seed), list(text)
    for _ in range(n):
        p, op = r.randrange(len(s)), r.randrange(3)
        if op == 0:
            s[p] = "#"
        elif op == 1:
            s.insert(p, "#")
        else:
            del s[p]
    return "".join(s)


def test_decontamination_finds_edited_passages_only(spark, empty):
    bench = spark.createDataFrame(list(enumerate(BENCH)), "item_id long, text string")
    texts = [f"Before it. {edited(BENCH[k], n, s)} After it." for k in (0, 1) for n in (0, 1, 3, 7) for s in range(3)]
    bad = len(texts)
    texts += [BENCH[0].upper().replace(" ", "\n"), " ".join([BENCH[0], "some words between them", BENCH[0]])]
    clean = ["The quick brown fox jumps over a fence. " * 20, BENCH[0][:40], "short one", None, "", "x" * 5000, "word " * 2000, edited(BENCH[0], 45, 1)]
    docs = spark.createDataFrame([(i, t, *[None] * 6) for i, t in enumerate(texts + clean)] * 2, SCHEMA)
    found = decontaminate.occurrences(docs, bench).collect()
    assert {r.doc_id for r in found} == set(range(bad + 2))
    for r in found:
        assert r.similarity >= 0.9 and r.item_id in (0, 1)
        if r.edits == 0 and r.doc_id < bad:
            assert texts[r.doc_id][r.first_char : r.end_char] == BENCH[r.item_id]
    assert sum(r.doc_id == bad + 1 for r in found) == 4  # two places, two equal rows
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(2 * list(range(bad + 2, bad + 2 + len(clean))))
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_alignment_equals_full_table():
    r = random.Random(9)
    for _ in range(60):
        item = bytes(r.choices(b"abc", k=20))
        text = bytes(r.choices(b"abc", k=15)) + edited(item.decode(), r.randrange(4), r.random()).encode() + bytes(r.choices(b"abc", k=15))
        last = [0] * (len(text) + 1)
        for c in item:
            new = [last[0] + 1]
            for j, t in enumerate(text):
                new.append(min(last[j] + (c != t), last[j + 1] + 1, new[j] + 1))
            last = new
        assert decontaminate.align(item, text, -20, len(text))[0] == min(last)


def test_long_texts_are_searched_in_overlapping_pieces(monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 300)
    index = decontaminate.build(list(enumerate(BENCH)))
    for before in range(0, 700, 37):
        text = "lorem " * (before // 6) + BENCH[0] + " ipsum" * 100
        found = decontaminate.search([None, text], index)
        assert [(f[0], f[1], f[4]) for f in found] == [(1, 0, 0)] and text[found[0][2] : found[0][3]] == BENCH[0]


def test_packing_round_trip(spark, odd, empty):
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = odd.dropDuplicates(["doc_id"])
    shards = packing.packed(docs, *args, width=64)
    got = {}
    for s in packing.unpack(shards).collect():
        got.setdefault(s.doc_id, []).append((s.offset, bytes(s.ids)))
    e = reference()
    for r in docs.collect():
        ids = np.array(e.encode_ordinary(r.text or ""), "<u4").tobytes()
        assert b"".join(x for _, x in sorted(got.get(r.doc_id, []))) == ids
    for row in packing.matrix_rows(shards).collect():
        ends, positions = row.cu_seqlens, np.frombuffer(row.positions, "<u4")
        assert len(row.ids) == 64 * 4 and ends[0] == 0 and ends[-1] <= 64 and ends == sorted(set(ends))
        for a, b in zip(ends, ends[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
        assert set(np.frombuffer(row.ids, "<u4")[ends[-1]:].tolist()) <= {50256}
    assert packing.packed(empty, *args).count() == 0


def test_packing_is_best_fit_decreasing():
    r = random.Random(4)
    for width in (1, 7, 64, 100):
        sizes = [r.randrange(0, 2 * width) for _ in range(200)]
        rows = packing.pack(packing.split(sizes, width), width)
        spaces = []
        for p in sorted(packing.split(sizes, width), key=lambda p: (-p.size, p.doc, p.offset)):
            fit = [s for s in spaces if s >= p.size]
            if fit:
                spaces.remove(min(fit))
                spaces.append(min(fit) - p.size)
            else:
                spaces.append(width - p.size)
        assert sorted(width - sum(p.size for p in row) for row in rows) == sorted(spaces)
        assert sum(p.size for row in rows for p in row) == sum(sizes)
