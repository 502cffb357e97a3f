"""Preparing several targets at once gives the designs of one at a time; medians are only worked out where values are missing."""

import math
import random

import pytest

from eventide.operators import cleaning, zoo

FEATURES, TARGETS = {"a": "ca", "b": "cb", "c": "cc"}, {"x": "tx", "y": "ty", "z": "tz"}


@pytest.fixture(scope="module")
def rows(spark):
    """x and y are missing in the same rows, z in others; a has gaps and NaN, c is whole."""
    r = random.Random(7)
    data = []
    for i in range(300):
        x = None if i % 11 == 0 else r.random()
        a = None if i % 5 == 0 else math.nan if i % 17 == 0 else r.random()
        data.append((i, f"s{i % 3}", a, None if i % 7 == 0 else float(r.randrange(9)), r.random(), x, None if x is None else x * 2 + r.random(), None if i % 13 == 0 else r.random()))
    return spark.createDataFrame(data, "day int, name string, ca double, cb double, cc double, tx double, ty double, tz double").repartition(4)


@pytest.mark.parametrize("impute", [True, False])
def test_designs_of_all_targets(rows, monkeypatch, impute):
    data = rows if impute else rows.fillna(0.5, ["ca"])
    alone = {h: zoo.prepare(data, FEATURES, c, ["day", "name"], impute=impute) for h, c in TARGETS.items()}
    targets, one = [], zoo.prepare
    monkeypatch.setattr(zoo, "prepare", lambda df, f, target, *a, **k: targets.append(target) or one(df, f, target, *a, **k))
    found = zoo.prepare_all(data, FEATURES, TARGETS, ["day", "name"], impute=impute)
    assert targets == ["tx", "tz"] and list(found) == list(TARGETS)
    for h, d in alone.items():
        mine = found[h]
        assert (mine.features, mine.n, mine.folds) == (d.features, d.n, d.folds)
        some = d.rows.columns
        got, want = (sorted(x.rows.select(some).collect(), key=lambda r: r["_pos"]) for x in (mine, d))
        assert len(got) == d.n
        for g, w in zip(got, want):
            assert [x if not isinstance(x, float) else pytest.approx(x, nan_ok=True) for x in w] == list(g)


def test_medians_only_where_values_are_missing(rows, monkeypatch):
    asked, all_medians = [], cleaning.medians
    monkeypatch.setattr(cleaning, "medians", lambda df, features: asked.append(features) or all_medians(df, features))
    names = ["ca", "cb", "cc"]
    got = sorted(cleaning.median_impute(rows.select("day", *names), names).collect())
    assert asked == [["ca", "cb"]]
    want = all_medians(rows, names)
    for g, r in zip(got, sorted(rows.select("day", *names).collect(), key=lambda r: r["day"])):
        assert list(g)[1:] == [want[c] if r[c] is None or math.isnan(r[c]) else r[c] for c in names]
    assert cleaning.median_impute(rows.select("cc"), ["cc"]).count() == 300 and len(asked) == 1
