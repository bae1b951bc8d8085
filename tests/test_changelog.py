"""Revisions, deltas and compaction of a stored log, against the same kept in plain Python."""

import random

import pytest

from tonearm.operators.changelog import ChangeLog, caught_up

SCHEMA = "id long, title string, size long, missing boolean"


def _state(spark, rows):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], SCHEMA)


def _ids(df):
    return sorted(r[0] for r in df.collect())


def test_sequence(spark):
    rows = {i: (f"t{i}", 1, False) for i in range(20)}
    log = ChangeLog.created(_state(spark, rows), "id", ["title", "missing"])
    assert log.revision() == 1 and log.record(_state(spark, rows)) == 1  # nothing changed
    d = log.delta(log.catalogue_id, 1)
    assert d.kind == "none" and d.changed is None
    rows[0] = ("t0", 99, False)
    assert log.record(_state(spark, rows)) == 1 and {r.id: r.size for r in log.current().collect()}[0] == 99  # stored, not shown
    rows[0], rows[1] = ("Renamed", 99, False), ("t1", 1, True)
    assert log.record(_state(spark, rows)) == 2
    d = log.delta(log.catalogue_id, 1, live="NOT missing")
    assert d.kind == "rows" and sorted((r.id, r.title, r.missing, r.rev) for r in d.changed.collect()) == [(0, "Renamed", False, 2), (1, "t1", True, 2)] and d.removed.count() == 0
    del rows[5]
    assert log.record(_state(spark, rows)) == 3 and _ids(log.delta(log.catalogue_id, 2).removed) == [5]
    rows[5] = (None, 1, None)
    assert log.record(_state(spark, rows)) == 4
    d = log.delta(None, 2)
    assert _ids(d.removed) == [] and _ids(d.changed) == [5]
    assert [log.delta(log.catalogue_id, n).kind for n in (-1, 5, 4)] == ["full", "full", "none"] and log.delta("other", 3).kind == "full"
    for i in range(6):
        rows[i + 10] = ("many", 1, False)
    assert log.record(_state(spark, rows)) == 5 and log.delta(log.catalogue_id, 4).kind == "full"


def test_copies_are_reported_as_removed(spark):
    rows = {i: ("t", 1, False) for i in range(20)}
    log = ChangeLog.created(_state(spark, rows), "id", ["title", "size"])
    rows[3], rows[4] = ("t", 7, False), ("u", 1, False)
    log.record(_state(spark, rows))
    d = log.delta(log.catalogue_id, 1, copies="size = 7")
    assert _ids(d.removed) == [3] and _ids(d.changed) == [4]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_histories(spark, seed):
    rng = random.Random(seed)
    rows = {i: (f"t{i}", i, False) for i in range(60)}
    log, states, revs = ChangeLog.created(_state(spark, rows), "id", ["title"]), [dict(rows)], [1]
    for step in range(5):
        for _ in range(rng.randrange(4)):
            rows[rng.randrange(70)] = (rng.choice(["a", "b", None]), rng.randrange(3), False)
        if rng.random() < 0.7 and rows:
            rows.pop(rng.choice(sorted(rows)))
        revs.append(log.record(_state(spark, rows)))
        states.append(dict(rows))
        if step == 2:
            log.compacted()
    assert revs == sorted(revs)
    assert {r.id: (r.title, r.size, r.missing) for r in log.current().collect()} == rows
    for old, rev in zip(states, revs):
        d = log.delta(log.catalogue_id, rev)
        titles = {r.id: r.title for r in caught_up(_state(spark, old), d, "id", log).collect()}
        assert titles == {k: v[0] for k, v in rows.items()}
        if d.kind == "rows":
            assert set(_ids(d.changed)) >= {k for k, v in rows.items() if k not in old or old[k][0] != v[0]}
            assert set(_ids(d.removed)) >= set(old) - set(rows)


def test_a_broken_off_commit_doesn_t_count(spark):
    rows = {i: ("t", 1, False) for i in range(9)}
    log = ChangeLog.created(_state(spark, rows), "id", ["title"])
    log.current().limit(3).write.parquet(f"{log.path}/rows/seq=2")  # its marker was never written
    assert log.revision() == 1 and log.current().count() == 9
    rows[2] = ("new", 1, False)
    assert log.record(_state(spark, rows)) == 2 and _ids(log.delta(None, 1).changed) == [2]


def test_a_delta_opens_later_commits_only(spark):
    rows = {i: ("t", 1, False) for i in range(50)}
    log = ChangeLog.created(_state(spark, rows), "id", ["title"])
    for i in range(3):
        rows[i] = ("new", 1, False)
        log.record(_state(spark, rows))
    assert {f.split("seq=")[1].split("/")[0] for f in log._latest(3).inputFiles()} == {"4"}
