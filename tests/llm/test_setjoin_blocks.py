"""Skipped blocks, colliding tokens, clusters in blocks: the links stay those of brute force."""

import math
import random

import numpy as np
import pytest

from tonearm.llm import setjoin
from tonearm.llm._components import components
from tonearm.llm.setjoin import list_pairs, near_duplicates, packed_postings, prefix_length, reached, verified_links

from .test_setjoin import _corpus, brute


def _entries(sets, low_bits=64):
    """Postings of sets whose order is that of the tokens themselves."""
    mask = np.int64((1 << low_bits) - 1 if low_bits < 64 else -1)
    tok, sid, n, place, lost = [], [], [], [], []
    for i, s in enumerate(sets):
        pre = np.sort(s)[: prefix_length(len(s))] & mask
        gone = len(pre) - len(np.unique(pre))
        for p, t in enumerate(pre.tolist()):
            if t not in pre[:p].tolist():
                tok.append(t), sid.append(i), n.append(len(s)), place.append(p), lost.append(gone)
    return tuple(np.array(x, dtype=np.int64) for x in (tok, sid, n, place, lost))


def _sets(rng, groups=12, copies=8):
    out = []
    for _ in range(groups):
        base = np.unique(rng.integers(0, 1 << 60, rng.integers(4, 120)))
        for _ in range(copies):
            kept = base[rng.random(len(base)) > rng.random() * 0.2]
            out.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 60, rng.integers(0, 2 + len(base) // 6))])))
    return [s for s in out if len(s)]


def _candidates(entries):
    total = {}
    for found in list_pairs(*entries):
        if len(found) == 2:
            continue
        for a, b, shared, na, nb, first, slack in zip(*(x.tolist() for x in found)):
            old = total.get((a, b), (0, 0, 0, 0, 0))
            total[a, b] = (old[0] + shared, max(old[1], first), na, nb, slack)
    return {ab for ab, (shared, first, na, nb, slack) in total.items() if first and shared >= max(1, math.ceil(3 * (na + nb) / 7) - math.ceil(3 * max(na, nb) / 4) + 1 - slack)}


@pytest.mark.parametrize("low_bits,at_once", [(64, 2_000_000), (64, 7), (9, 2_000_000)])
def test_no_link_is_skipped(monkeypatch, low_bits, at_once):
    monkeypatch.setattr(setjoin, "LONG", 10**9)
    monkeypatch.setattr(setjoin, "PAIRS_AT_ONCE", at_once)
    rng = np.random.default_rng(4)
    for _ in range(10):
        sets = _sets(rng)
        found = _candidates(_entries(sets, low_bits))
        for i, s in enumerate(sets):
            for j in range(i):
                o = len(np.intersect1d(s, sets[j]))
                if 100 * o >= 75 * (len(s) + len(sets[j]) - o):
                    assert (j, i) in found


def test_blocks_are_skipped():
    tok, sid, n, place, _ = _entries(_sets(np.random.default_rng(9), groups=20))
    by = np.lexsort((sid, place, n, tok))
    tok, n, place = tok[by], n[by], place[by]
    end = reached(tok, n, place)
    all_pairs = built = sized = 0
    for t in np.unique(tok).tolist():
        at = np.flatnonzero(tok == t)
        for k, x in enumerate(at.tolist()):
            assert end[x] <= at[-1] + 1 and [y for y in at[k + 1 :].tolist() if n[x] - place[x] >= -(-3 * n[y] // 4)] == list(range(x + 1, max(x + 1, end[x])))
            all_pairs, built = all_pairs + len(at) - k - 1, built + max(0, end[x] - x - 1)
            sized += sum(4 * n[x] >= 3 * n[y] for y in at[k + 1 :])
    print(f"{built} pairs built of {all_pairs}, {sized} by size alone")
    assert built < 0.9 * all_pairs and built < sized


def test_packing_and_collisions():
    pre = [np.array([1, 5 << 32 | 1, 7, 2 << 32], dtype=np.uint64), np.array([7], dtype=np.uint64), np.array([7 << 32 | 7, 9], dtype=np.uint64)]
    rows = {r["bucket"]: {k: np.frombuffer(v, {"sids": "<i8", "tokens": "<u4", "places": "<u2"}.get(k, "<i4")).tolist() for k, v in r.items() if k != "bucket"} for r in packed_postings(pre, [10, 11, 12], [40, 3, 8], 2).to_pylist()}
    assert rows[0] == {"sids": [10, 11, 12], "sizes": [40, 3, 8], "lost": [0, 0, 0], "many": [3, 1, 1], "tokens": [1, 7, 0, 7, 9], "places": [0, 2, 3, 0, 1]}
    assert rows[1] == {"sids": [10, 12], "sizes": [40, 8], "lost": [0, 0], "many": [1, 1], "tokens": [1, 7], "places": [1, 0]}
    (one,) = packed_postings(pre[:1], [10], [40], 1).to_pylist()
    assert np.frombuffer(one["lost"], "<i4").tolist() == [1]


@pytest.mark.parametrize("block,rows", [(150, 1_000_000), (150, 0), (10**9, 0)])
def test_one_cluster_in_blocks(spark, monkeypatch, block, rows):
    monkeypatch.setattr(setjoin, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(setjoin, "BROADCAST_ROWS", rows)
    texts = [r for r in _corpus(3, groups=6, copies=10, words=60) if r[1].strip()]
    want = brute(texts)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    members = spark.createDataFrame([(d, 1, want[d][0]) for d, _ in texts], "doc_id long, cluster long, n int")
    root = {r.node: r.root for r in components(verified_links(docs, members)).collect()}
    assert {d: root.get(d, d) for d, _ in texts} == {d: c for d, (_, c) in want.items()}


def test_many_copies_of_one_text_and_small_limits(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(setjoin, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(setjoin, "LONG", 2)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for d in range(120):
        w = list(base)
        w[rng.randrange(80)] = f"e{d % 50}"
        rows.append((d, " ".join(w)))
    rows += [(500 + d, " ".join(base[:60] + [f"z{d}_{i}" for i in range(30 + d)])) for d in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()} == brute(rows)


def test_a_very_long_text(spark):
    w = [f"w{i * 7919 % 100_003}" for i in range(100_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:90_000])), (3, " ".join(w[:60_000])), (4, "x" * 1_000_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (99_996, 1), 2: (89_996, 1), 3: (59_996, 3), 4: (1, 4)}


def test_rounds_that_do_not_suffice(spark):
    with pytest.raises(RuntimeError, match="settle"):
        components(spark.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long"), most_rounds=1)
