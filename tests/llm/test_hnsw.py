import math

import numpy as np

from tonearm.llm.hnsw import Graph, build_index, neighbours, search_index, usable


def _brute(rows, every, k):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for i, x in ok:
        if i % every == 0:
            out[i] = sorted((float(np.sqrt(((y - x) ** 2).sum())), j) for j, y in ok if j != i)[:k]
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(120)]
    rows += [(i, rows[7][1]) for i in range(200, 230)] + [(i, rows[0][1]) for i in (300, 301)]
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [None] + [1.0] * 7), (404, [float("nan")] * 8), (405, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (406, [1.0] * 9), (501, [1e30] * 8)]
    table = spark.createDataFrame([(a, b, 1, 2.0) for a, b in rows], "vec_id long, embedding array<float>, rank int, score double")
    want = _brute(rows, 100, 10)
    good = usable(table)
    for got in (neighbours(table, 100, 10).collect(), search_index(build_index(good, shard_rows=40), good.where("vec_id % 100 = 0"), 10).collect()):
        mine = {}
        for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
            mine.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert mine == want


def test_recall_with_clumps():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32))
    x[:800] = x[0]
    x[800:1300] = x[0] + rng.normal(size=(500, 32)) * 1e-3
    graph = Graph.from_bytes(Graph.build(np.arange(3000), x).to_bytes())
    hit = 0
    for q in range(0, 3000, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len(set(graph.search(q, x[q], 10)) & set(sorted(zip(d.tolist(), range(3000)))[:10]))
    assert hit / 600 >= 0.95


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours(spark.createDataFrame([], schema)).count() == 0
    assert neighbours(spark.createDataFrame([(100, [1.0, 2.0])], schema)).count() == 0
    got = neighbours(spark.createDataFrame([(100, [1.0, 2.0]), (1, [1.0, 2.0]), (100, [1.0, 2.0])], schema)).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(100, 1, 1, 0.0)]
