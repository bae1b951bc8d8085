"""The windows of the batch fold give what the fold gives row by row, without Python on executors."""

import random

import pytest

from tonearm.operators.sessions import DAY_MS, Fold, fold_places, fold_sessions

MOVES = "book_id long, user_id long, offset_ms long, now_ms long, duration_ms long"


def by_rows(rows, gap):
    groups = {}
    for b, u, offset, now, duration in rows:
        groups.setdefault((b, u), []).append((now, offset, duration))
    places, sessions = [], []
    for key, moves in groups.items():
        fold = Fold(max(d or 0 for _, _, d in moves), gap)
        for now, offset, _ in sorted(moves, key=lambda m: m[:2]):
            fold.update(offset, now)
        places.append((*key, fold.offset, max(m[0] for m in moves), fold.finished_at, fold.seq))
        sessions += [(*key, *c, False) for c in fold.closed] + [(*key, fold.seq - 1, *fold.session, True)]
    return places, sessions


@pytest.mark.parametrize("seed", range(3))
def test_as_row_by_row(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(3), u if u else None, rng.choice([-3, 0, 1, 1, 2, 97, 99, 200]), rng.randrange(-5, 40) * DAY_MS // 12, rng.choice([None, 0, 100]) if u % 3 else rng.choice([None, 0, -1])) for u in range(60) for _ in range(20)]
    places, sessions = by_rows(rows, DAY_MS // 8)
    moves = spark.createDataFrame(rows, MOVES).repartition(5)
    assert sorted(map(str, (tuple(r) for r in fold_places(moves, DAY_MS // 8).collect()))) == sorted(map(str, places))
    assert sorted(map(str, (tuple(r) for r in fold_sessions(moves, DAY_MS // 8).collect()))) == sorted(map(str, sessions))


def test_no_group_runs_in_python(spark):
    moves = spark.createDataFrame([(1, 1, 5, 5, 100)], MOVES)
    for df in (fold_places(moves), fold_sessions(moves)):
        assert "Pandas" not in df._jdf.queryExecution().optimizedPlan().toString()
