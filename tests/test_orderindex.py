"""Pages of a stored order: any of them reads a range or two."""

import random

from pyspark.sql import functions as F

from tonearm.operators.orderindex import ordered


def test_pages(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1, 2, 3, 50]), rng.choice("abc")) for i in range(437)]
    df = spark.createDataFrame(rows, "id long, year long, t string").repartition(5)
    index = ordered(df, [(F.col("year"), False), (F.lower("t"), True), (F.col("id"), True)], rows=50)
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], r[0]))]
    assert index.total() == 437 and index.manifest().count() >= 8
    for number, size in ((1, 20), (3, 33), (21, 20), (22, 20), (23, 20), (44, 10), (1, 500), (9, 50), (0, 7)):
        at = (max(1, number) - 1) * size
        page = index.page(number, size)
        assert [r.id for r in page.collect()] == want[at : at + size] and page.columns == ["id", "year", "t"]
    assert [r.id for r in index.page(1, -1).collect()] == want
    first, last = (len(index.page(n, 10).inputFiles()) for n in (1, 43))
    assert first <= 2 and last <= 2
    assert index.page(1, 900).count() == 437  # clamped to 500


def test_empty(spark):
    index = ordered(spark.createDataFrame([], "id long"), [(F.col("id"), True)])
    assert index.total() == 0 and index.page(1).count() == 0
