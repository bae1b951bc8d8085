"""The graph against an exact scan, its shape, ties, and rows stored in another way."""

import time

import numpy as np

from tonearm.llm.hnsw import M, Graph, neighbours


def _truth(x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    d[q] = np.inf
    return sorted(zip(d.tolist(), range(len(x))))[:k]


def test_recall_and_work_against_an_exact_scan():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(400, 32))
    x = centres[rng.integers(0, 400, 20_000)] + 0.3 * rng.normal(size=(20_000, 32))
    graph = Graph.build(np.arange(len(x)), x)
    per_node, graph.evaluations = graph.evaluations / len(x), 0
    asked = np.arange(0, len(x), 100)
    t0 = time.time()
    found = {}
    for q, _, v in graph.search_block(asked, x[asked], 10):
        found.setdefault(q, set()).add(v)
    graph_s, t0 = time.time() - t0, time.time()
    hit = sum(len(found[q] & {v for _, v in _truth(x, q, 10)}) for q in asked.tolist())
    recall, share = hit / 10 / len(asked), graph.evaluations / len(asked) / len(x)
    print(f"recall {recall:.4f}; distances a query {share:.3f} of an exact scan's, a node's insertion {per_node:.0f}; {graph_s:.2f} s, exact loop {time.time() - t0:.2f} s")
    assert recall >= 0.95 and share < 0.25 and per_node < 0.25 * len(x)


def test_shape():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 6))
    graph = Graph.build(np.arange(1500), np.concatenate([x[:1400], x[:100]]))
    assert len(graph.x) == 1400 and sum(len(range(a, b)) for a, b in zip([0, *graph.ends], graph.ends)) == 1500
    assert [len(rows) for rows in graph.links] == sorted((len(rows) for rows in graph.links), reverse=True) and len(graph.links[0]) == 1400
    for layer, links in enumerate(graph.links):
        assert links.shape[1] == (2 * M if layer == 0 else M) and links.max() < len(links)
        for node, own in enumerate(links):
            own = own[own >= 0].tolist()
            assert node not in own and len(own) == len(set(own)) and (own or len(links) == 1)
    reach, todo = {0}, [0]
    while todo:
        for j in graph.links[0][todo.pop()].tolist():
            if j >= 0 and j not in reach:
                reach.add(j)
                todo.append(j)
    assert len(reach) == 1400


def test_ties_between_different_vectors_and_far_scales():
    ring = [[np.cos(a), np.sin(a)] for a in np.arange(0, 2 * np.pi, np.pi / 2)]
    x = np.array([[0.0, 0.0]] + ring * 1 + [[1.0 + 1e-9, 0.0], [0.0, 5.0]])
    x = np.concatenate([x, 1e150 * np.array([[1.0, 1.0], [1.0, 2.0]])])
    got = Graph.build(np.arange(len(x)), x).search(0, x[0], 3)
    assert got == [(float(np.sqrt((x[v] ** 2).sum())), v) for v in sorted(range(1, 5), key=lambda v: (np.sqrt((x[v] ** 2).sum()), v))[:3]]


def test_order_and_partitions_of_rows_do_not_matter(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(3000)]
    schema = "vec_id long, embedding array<double>"
    one = neighbours(spark.createDataFrame(rows, schema).repartition(7), 50, 10).collect()
    two = neighbours(spark.createDataFrame(rows[::-1], schema).repartition(2), 50, 10).collect()
    assert sorted(one) == sorted(two) and len(one) == 600
