"""Steps that read or shuffle less, against the plain way of saying the same."""

import datetime as dt

import numpy as np
import pytest

from eventide.operators import joins, neighbours, views
from eventide.operators.returns import forward_returns, price_window
from eventide.plans import q_io

D = dt.date


def test_dataset_metadata_lists_every_company(spark):
    rows = [("b", "2024-01-02"), ("a", "2024-01-01"), ("b", "2024-03-01")]
    got = views.dataset_metadata(spark.createDataFrame(rows, "symbol string, day string"), "symbol", "day").first()
    assert tuple(got) == (3, ["a", "b"], "2024-01-01", "2024-03-01")
    none = views.dataset_metadata(spark.createDataFrame([], "symbol string, day string"), "symbol", "day").first()
    assert tuple(none) == (0, [], None, None)


def test_price_window_meets_bars_by_slots_not_by_days(spark):
    rng = np.random.default_rng(8)
    days = [D(2024, 1, 1) + dt.timedelta(i) for i in range(150)]
    bars = [(s, d, float(i)) for s in "ab" for i, d in enumerate(days) if rng.random() < 0.6]
    events = [(s, int(k), days[int(k)]) for s in "abc" for k in rng.integers(0, 150, 25)]
    ev = spark.createDataFrame(events, "symbol string, k int, event_date date")
    for after in (0, 30):
        got = price_window(ev, spark.createDataFrame(bars, "symbol string, date date, close double"), after)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence(" not in plan and "strategy=merge" in plan
        want = [(s, d, k, e, c) for s, k, e in events for t, d, c in bars if s == t and e - dt.timedelta(5) <= d < e + dt.timedelta(after + 10)]
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_events_are_not_broadcast_for_the_size_of_their_source(spark):
    """Many quarters of few suppliers look as small as the suppliers; a broadcast of all events went through the driver."""
    days = [D(2024, 1, 1) + dt.timedelta(i) for i in range(60)]
    bars = spark.createDataFrame([(s, d, 1.0 + i) for s in "ab" for i, d in enumerate(days)], "symbol string, date date, close double")
    events = spark.createDataFrame([("a",), ("c",)], "symbol string").crossJoin(spark.createDataFrame([(d,) for d in days[10:15]], "event_date date"))
    for found in (forward_returns(events, bars, horizons={"1D": 1}), joins.asof_forward(events, bars, 3)):
        plan = found._jdf.queryExecution()
        assert "strategy=merge" in plan.optimizedPlan().toString() and "SortMergeJoin" in plan.sparkPlan().toString()
        assert sorted(r["event_date"] for r in found.collect()) == days[10:15]


def test_sink_experiments_works_its_input_out_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def watched(parts):
        for p in parts:
            seen.add(len(p))
            yield p

    rows = spark.createDataFrame([(float(i), None, 1.0, 2.0) for i in range(7)], "return_1D double, return_5D double, return_10D double, return_21D double")
    monkeypatch.setattr(q_io.wh, "dataset", lambda *_: rows.mapInPandas(watched, rows.schema))
    got = sorted(map(tuple, q_io.q_sink_experiments(spark, "").collect()))
    assert got == sorted((h, n, run) for run in (1, 2) for h, n in (("1D", 7), ("5D", 0), ("10D", 7), ("21D", 7)))
    assert seen.value == 7


def all_distances(qx, qy, x, y, k):
    d = np.sort(np.maximum(np.abs(qx[:, None] - x), np.abs(qy[:, None] - y)), axis=1)[:, :k]
    return np.pad(d, ((0, 0), (0, k - d.shape[1])), constant_values=neighbours._FAR)


@pytest.mark.parametrize("chunk", [50, 2_000_000])
def test_nearest_and_reached_strips_against_all(monkeypatch, chunk):
    monkeypatch.setattr(neighbours, "_CHUNK", chunk)
    rng = np.random.default_rng(11)
    draw = [lambda n: rng.integers(-10**6, 10**6, n), lambda n: rng.integers(0, 4, n) * 1000, lambda n: np.zeros(n, np.int64),
            lambda n: np.where(rng.random(n) < 0.5, 7, rng.integers(-50, 50, n)), lambda n: (rng.standard_cauchy(n) * 1e6).astype(np.int64)]
    for a in draw:
        for b in draw:
            for n, m in ((300, 40), (2, 5), (0, 3)):
                x, y, qx, qy = a(n), b(n), a(m), b(m)
                assert (neighbours._nearest(qx, qy, x, y, 4) == all_distances(qx, qy, x, y, 4)).all()
            x, y = a(400), b(400)
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            box = np.array([(s, x[i].min(), x[i].max(), y[i].min(), y[i].max()) for s in range(5, 15) for i in [slice((s - 5) * 40, (s - 4) * 40)]])
            px, py = x[120:160], y[120:160]
            reach = all_distances(px, py, px, py, 4)[:, -1]
            got = list(zip(*(v.tolist() for v in neighbours._reached(box, px, py, reach, 8))))
            assert got == [(i, s) for i, (u, v, r) in enumerate(zip(px, py, reach)) for s, c, d, e, f in box.tolist()
                           if s != 8 and c < u + r and d > u - r and e < v + r and f > v - r]


def test_nearest_looks_at_few_of_the_rows(monkeypatch):
    rng, n, looked, plain = np.random.default_rng(12), 20_000, [], np.maximum
    monkeypatch.setattr(np, "maximum", lambda *a, **o: (lambda d: (looked.append(d.size), d)[1])(plain(*a, **o)))
    for x in (rng.integers(-10**9, 10**9, n), rng.integers(0, 5, n) * 10**6, rng.integers(0, 100, n)):
        for y in (rng.integers(-10**9, 10**9, n), rng.integers(0, 100, n)):
            neighbours._nearest(x, y, x, y, 4)
    assert sum(looked) < 6 * 500 * n  # all distances: 6 * n * n
