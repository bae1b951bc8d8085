import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tonearm.llm import setjoin
from tonearm.llm._components import components
from tonearm.llm.setjoin import deduplicated, join_cluster, near_duplicates


def brute(rows):
    """doc_id -> (n_shingles, component) by comparing all pairs that share a shingle."""

    def shingle(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {d: shingle(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lists = defaultdict(list)
    for d in sorted(sets):
        seen = Counter(e for s in sets[d] for e in lists[s])
        for e, o in seen.items():
            if 100 * o >= 75 * (len(sets[d]) + len(sets[e]) - o):
                a, b = sorted((find(d), find(e)))
                root[b] = a
        for s in sets[d]:
            lists[s].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


def _corpus(seed, groups=12, copies=14, words=90):
    rng = random.Random(seed)
    passage = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows, d = [], 0
    for g in range(groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(3, words))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 12) + 1)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                w = w + passage
            rows.append((d * 3 % 997, " ".join(w).replace("w1", rng.choice(["W1", "w1"]))))
            d += 1
    return rows + [(2000, ""), (2001, " \n"), (2002, "one"), (2003, "ONE"), (2004, "one two")]


@pytest.mark.parametrize("long_lists,blocks", [(64, 400_000), (4, 400_000), (4, 400)])
def test_against_brute_force(spark, monkeypatch, long_lists, blocks):
    monkeypatch.setattr(setjoin, "LONG", long_lists)
    monkeypatch.setattr(setjoin, "BLOCK_SHINGLES", blocks)
    rows = _corpus(long_lists)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, component_id string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_edges_of_the_threshold(spark):
    w = [f"x{i}" for i in range(40)]
    rows = [(9, " ".join(w[:34])), (5, " ".join(w[:40])), (7, " ".join(w[:31])), (3, " ".join(w[:27] + ["y"]))]  # 30, 36, 27 and 24 shingles
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_nulls_copies_and_empty(spark):
    schema = "doc_id long, text string"
    rows = [(4, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "p q r s t u"), (8, None), (2, "a b c d e f")]
    got = near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted(((r.doc_id, r.component_id, r.n_shingles) for r in got), key=str) == sorted([(4, 2, 2), (2, 2, 2), (2, 2, 2), (None, 2, 2), (None, None, 2), (8, 8, 0)], key=str)
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    kept = deduplicated(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.doc_id) for r in kept)) == ["2", "8", "None", "None"]


def test_cluster_join_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(25):
        sets = []
        for _ in range(3):
            base = np.unique(rng.integers(0, 1 << 40, rng.integers(5, 80)).astype(np.uint64))
            for _ in range(10):
                keep = base[rng.random(len(base)) > rng.random() * 0.3]
                sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 40, rng.integers(0, 1 + len(base) // 4)).astype(np.uint64)])))
        lab = np.arange(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                o = len(np.intersect1d(sets[i], sets[j]))
                u = len(sets[i]) + len(sets[j]) - o
                if u and 100 * o >= 75 * u and lab[i] != lab[j]:
                    lab[lab == max(lab[i], lab[j])] = min(lab[i], lab[j])
        assert join_cluster(sets).tolist() == lab.tolist()


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(6000, 6100)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
