"""Queries over whole tables against brute force on small fixtures."""

from types import SimpleNamespace

from tonearm.plans import browse, shapes


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_every_part_gets_its_best_match(spark):
    parts = [(1, "small ring", "T", "B"), (2, "small rings", "T", "B"), (3, "tall ring", "T", "B"), (10, "zzz", "T", "B"), (11, "small ring", "T", "C"), (21, "small ring", "U", "B"), (22, "small wing", "U", "B")]
    got = shapes.levenshtein_match(SimpleNamespace(part=spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_brand string"))).collect()
    want = set()
    for a, n, *_ in parts:
        found = [(1 - _distance(n, m) / max(len(n), len(m)), b) for b, m, *_ in parts if b != a]
        if found and max(found)[0] >= 0.3:
            want.add((a, max(found)[1], round(max(found)[0], 4)))
    assert {a for a, *_ in want} == {1, 2, 3, 11, 21, 22}
    assert {(r.a, r.b, round(r.confidence, 4)) for r in got} == want and len(got) == len(want)


def test_zero_durations_are_null_rows(spark):
    got = dict(map(tuple, shapes.duration_text(SimpleNamespace(events=spark.createDataFrame([(0,), (3600,), (300,), (301,), (7,)], "event_id long"))).collect()))
    assert got == {0: None, 3600: None, 300: 300_000, 301: 61_000, 7: None}


def test_natural_order_ranks_every_row(spark):
    rows = [(i, f"Part {n}") for i, n in enumerate([*range(150, 0, -1), "010", "x2", "X10", "x02"])]
    spark_rows = spark.createDataFrame(rows, "c_custkey long, c_name string")
    got = sorted((r.r, r.c_custkey) for r in browse.natural_sort(SimpleNamespace(customer=spark_rows)).collect())

    def key(row):
        tail = row[1][5:].lower()
        return ("", int(tail)) if tail.isdigit() else ("x", int(tail[1:]))

    assert got == [(k, i) for k, (i, _) in enumerate(sorted(rows, key=lambda r: (key(r), r[0])), 1)]


def test_order_without_case_ranks_every_row(spark):
    rows = [(i, c * 3 if i % 2 else c.upper()) for i, c in enumerate("zyxwvutsrqponmlkjihgfedcba" * 3)]
    got = sorted((r.r, r.p_partkey) for r in browse.sort_no_case_whole(SimpleNamespace(part=spark.createDataFrame(rows, "p_partkey long, p_name string"))).collect())
    by_key = sorted(rows)
    assert got == [(k, i) for k, (i, _) in enumerate(sorted(by_key, key=lambda r: r[1].lower(), reverse=True), 1)]
