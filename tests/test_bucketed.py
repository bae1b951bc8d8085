"""Merges and deletes rewrite the buckets they touch and no others."""

import pytest

from tonearm.operators.bucketed import BucketedTable

SCHEMA = "k long, s string, v double"


def _table(spark, n=200, buckets=16):
    return BucketedTable.created(spark.createDataFrame([(i, "a", float(i)) for i in range(n)], SCHEMA), ["k"], buckets)


def test_merge_insert_delete_rebuild(spark):
    table = _table(spark)
    want = {i: ("a", float(i)) for i in range(200)}
    before = table.folders()
    new = spark.createDataFrame([(7, "b", 0.0), (900, None, 1.0)], SCHEMA)
    assert table.merged(new) == len(table.touched(new)) <= 2
    want |= {7: ("b", 0.0), 900: (None, 1.0)}
    after = table.folders()
    assert {b for b in after if after[b] != before.get(b)} == set(table.touched(new))  # other buckets keep their files
    assert {r.k: (r.s, r.v) for r in table.rows().collect()} == want
    table.merged(spark.createDataFrame([(8, "c", 5.0)], SCHEMA), lambda c, old, new: new if c == "s" else old)
    want[8] = ("c", 8.0)
    table.inserted(spark.createDataFrame([(8, "x", 5.0), (901, "y", 2.0)], SCHEMA))
    want[901] = ("y", 2.0)
    table.deleted(spark.createDataFrame([(i,) for i in range(20)], "k long"))
    want = {k: v for k, v in want.items() if k >= 20}
    assert {r.k: (r.s, r.v) for r in table.rows().collect()} == want
    table.rebuilt(lambda old: old.where("k % 2 = 0"))
    assert {r.k: (r.s, r.v) for r in table.rows().collect()} == {k: v for k, v in want.items() if k % 2 == 0}
    assert table.version() == 6


def test_a_broken_off_change_isn_t_seen(spark):
    table = _table(spark, 50, 4)
    with pytest.raises(Exception):
        table._changed(spark.createDataFrame([(1, "x", 0.0)], SCHEMA), lambda old: old.selectExpr("k", "s", "raise_error('stop') AS v"))
    assert table.version() == 1 and table.rows().count() == 50
    table.merged(spark.createDataFrame([(1, "x", 0.0)], SCHEMA))
    assert table.rows().where("s = 'x'").count() == 1


def test_only_touched_buckets_are_read(spark):
    table = _table(spark)
    new, seen = spark.createDataFrame([(3, "b", 0.0)], SCHEMA), []
    table._changed(new, lambda old: (seen.append(old.inputFiles()), old)[1])
    (folder,) = [f for b, f in _folders(table, 1).items() if b in table.touched(new)]
    assert seen[0] and all(f.startswith(folder) for f in seen[0])


def _folders(table, version):
    return {r["bucket"]: r["folder"] for r in table.spark.read.parquet(f"{table.path}/manifest/v{version:09d}").collect()}


def test_empty(spark):
    table = BucketedTable.created(spark.createDataFrame([], SCHEMA), ["k"], 4)
    assert table.rows().count() == 0 and table.merged(spark.createDataFrame([], SCHEMA)) == 0
    table.merged(spark.createDataFrame([(1, "a", 1.0)], SCHEMA))
    table.deleted(spark.createDataFrame([(1,)], "k long"))
    assert table.rows().count() == 0
