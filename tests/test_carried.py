"""Ordered state over many ranges gives what one window a key gives, also where one key has most rows."""

import random

import pytest

from tonearm.operators import analytic, carried, relational
from tonearm.operators.carried import carried_forward, carried_sum


def _rows(seed=1, n=900):
    rng = random.Random(seed)
    keys = ["hot"] * 700 + [rng.choice(["a", "b", None, "z"]) for _ in range(n - 700)]
    return [(k, rng.randrange(10**6), i, rng.choice([None, 40.0, 55.5, 75.0, -90.0]), rng.choice(["x", "y", None])) for i, k in enumerate(keys)]


@pytest.fixture(params=[False, True])
def split(request, monkeypatch):
    monkeypatch.setattr(carried, "ROWS_OF_A_TASK", 50 if request.param else 10**9)
    return request.param


@pytest.fixture(scope="module")
def table(spark):
    return _rows(), spark.createDataFrame(_rows(), "k string, t long, i long, v double, w string").repartition(6)


def _groups(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_last_sum_and_change(spark, table, split):
    rows, df = table
    last, before, changed, sums, state = {}, {}, set(), {}, {}
    for g in _groups(rows).values():
        seen, prev, total, on = None, "none", 0, False
        for k, t, i, v, w in g:
            before[i], sums[i] = seen, total
            seen = v if v is not None else seen
            last[i], total = seen, total + t
            on = False if v is None or v > 70 else True if v <= 50 else on
            state[i] = on
            if w != prev:
                changed.add(i)
            prev = w
    from pyspark.sql import functions as F

    assert {r.i: r.o for r in carried_forward(df, "k", ["t", "i"], F.col("v"), "o").collect()} == last
    assert {r.i: r.o for r in carried_forward(df, "k", ["t", "i"], F.col("v"), "o", own=False).collect()} == before
    assert {r.i: r.o for r in carried_sum(df, "k", ["t", "i"], F.col("t"), "o").collect()} == sums
    assert {r.i for r in analytic.changed_rows(df, "k", ["t", "i"], "w").collect()} == changed
    assert {r.i: r.matched for r in analytic.hysteresis(df, "k", ["t", "i"], "v", 50.0, 70.0).collect()} == state


def test_next_start(spark, table, split):
    rows, df = table
    from pyspark.sql import functions as F

    got = {r.i: r.duration_ms for r in analytic.chapter_durations(df.withColumn("e", F.lit(2 * 10**6)), "k", "t", "e", ["t", "i"]).collect()}
    want = {a[2]: (b[1] if b else 2 * 10**6) - a[1] for g in _groups(rows).values() for a, b in zip(g, g[1:] + [None])}
    assert got == want


def test_as_of_and_intervals(spark, split):
    rng = random.Random(3)
    points = [("hot" if rng.random() < 0.8 else rng.choice("ab"), rng.randrange(1000), i) for i in range(500)]
    spans = [("hot" if rng.random() < 0.8 else rng.choice("ac"), rng.randrange(1000), i) for i in range(300)]
    got = {r.i: r.found_id for r in relational.starting_at_or_before(spark.createDataFrame(points, "k string, t long, i long").repartition(4), spark.createDataFrame(spans, "k string, s long, id long"), "k", "t", "s", "id", ["id"]).collect()}
    assert got == {i: max(((s, j) for q, s, j in spans if q == k and s <= t), default=(0, None))[1] for k, t, i in points}
    parts, start = [], {}
    for j in range(300):
        book = "hot" if rng.random() < 0.8 else rng.choice("ac")
        d = rng.choice([0, 1, 7, 30])
        parts.append((book, j, start.get(book, 0), d))
        start[book] = start.get(book, 0) + d
    xs = [("hot" if rng.random() < 0.8 else rng.choice("ab"), rng.randrange(-5, 4000), i) for i in range(400)]
    got = {r.i: (r.part_index, r.within_ms) for r in relational.resolve_offset(spark.createDataFrame(xs, "book_id string, x long, i long").repartition(4), spark.createDataFrame(parts, "book_id string, part_index long, start_offset_ms long, duration_ms long")).collect()}
    want = {}
    for book, x, i in xs:
        mine, x = [p for p in parts if p[0] == book], max(x, 0)
        if mine:
            hit = next((p for p in mine if x < p[2] + p[3]), None)
            want[i] = (hit[1], max(0, x - hit[2])) if hit else (mine[-1][1], mine[-1][3])
    assert got == want


def test_recurrences(spark, table):
    rows, df = table
    rates, peaks = {}, {}
    for k, g in _groups(rows).items():
        for *_, v, _ in g:
            if v is not None:
                rates[k] = v if k not in rates else rates[k] * 0.7 + v * 0.3
            peaks[k] = max(abs(v or 0.0), peaks.get(k, 0.0) * 0.9)
    from pyspark.sql import functions as F

    one = df.withColumn("at", F.struct("t", "i"))
    assert {r.k: r.rate for r in analytic.ewma(one, "k", "at", "v").collect()} == pytest.approx(rates)
    assert {r.k: r.peak for r in analytic.peak_hold(one, "k", "at", "v", 0.9).collect()} == pytest.approx(peaks)


def test_a_hot_key_is_many_tasks_work(spark, table, monkeypatch):
    """Ranges of the hot key: none holds most of it."""
    from pyspark.sql import functions as F

    _, df = table
    seen = []
    monkeypatch.setattr(carried, "ROWS_OF_A_TASK", 50)
    real = carried.cut
    monkeypatch.setattr(carried, "cut", lambda d: (seen.append(real(d)), seen[-1])[1])
    carried_forward(df, "k", ["t", "i"], F.col("v"), "o").count()
    shares = [r["count"] for r in seen[0].where("k = 'hot'").groupBy("__p").count().collect()]
    assert len(shares) > 1 and max(shares) < 700
