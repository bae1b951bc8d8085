"""SimHash fingerprints, trees and components against plain loops."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tonearm.llm import simhash
from tonearm.llm._components import components
from tonearm.llm.simhash import Tree, fingerprint, forest, links, masks, near_duplicates


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    bits = Counter(b for p in parts for b in range(64) if xxhash.xxh64_intdigest(p.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(parts))


def brute(fps):
    """Least index of each fingerprint's component."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def _fps(seed, groups=25, each=12, flips=4):
    rng, out = random.Random(seed), set()
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(each):
            f = base
            for _ in range(rng.randrange(flips)):
                f ^= 1 << rng.randrange(64)
            out.add(f)
    return sorted(out | {0, (1 << 64) - 1, 1 << 63})


def test_fingerprints():
    rng = random.Random(1)
    texts = ["", None, " \n\t", "one", "ONE", "one two", "a b c", "É é Ä b", "x\x1cy z", "a\x0bb\x0cc d"] + [" ".join(rng.choice(["The", "cat", "ran", "é", "日本"]) for _ in range(rng.randrange(1, 40))) for _ in range(50)]
    for t in texts:
        assert fingerprint((t or "").encode()) == plain(t)
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    assert fingerprint(long.encode(), at_once=1000) == plain(long)


def test_tree_is_a_bk_tree_and_searches_whole_radius():
    fps = np.array(_fps(2), dtype=np.uint64)
    t = Tree(fps)
    assert sorted(t.fps.tolist()) == sorted(fps.tolist()) and sorted(t.order.tolist()) == list(range(len(fps)))
    seen = set()
    for i in range(1, len(fps)):
        assert (int(t.fps[i]) ^ int(t.fps[t.parent[i]])).bit_count() == t.edge[i] and (t.parent[i], t.edge[i]) not in seen
        seen.add((t.parent[i], t.edge[i]))
    for radius in (0, 3, 8):
        q, node, visited = t.within(fps, radius)
        want = {(i, j) for i, a in enumerate(fps.tolist()) for j, b in enumerate(t.fps.tolist()) if (a ^ b).bit_count() <= radius}
        assert set(zip(q.tolist(), node.tolist())) == want and len(q) == len(want)
    assert t.within(fps, 3)[2] < 0.9 * len(fps) ** 2


@pytest.mark.parametrize("flips", [2, 4, 9])
def test_forest(monkeypatch, flips):
    monkeypatch.setattr(simhash, "VISITS", 4000)
    fps = _fps(3, flips=flips)
    want = brute(fps)

    def labels(edges):
        root = {f: f for f in fps}
        for a, b in edges:
            x, y = root[a], root[b]
            root = {f: min(x, y) if r in (x, y) else r for f, r in root.items()}
        return [fps.index(root[f]) for f in fps]

    a, b, _ = forest(Tree(np.array(fps, dtype=np.uint64)))
    assert labels(zip(a.tolist(), b.tolist())) == want and len(a) == len(fps) - len(set(want))
    even, odd = np.array(fps[::2], dtype=np.uint64), np.array(fps[1::2], dtype=np.uint64)
    edges = [e for x in (forest(Tree(even)), forest(Tree(odd)), forest(Tree(even), odd)) for e in zip(x[0].tolist(), x[1].tolist())]
    assert labels(edges) == want


def test_a_dense_group_isn_t_compared_pair_by_pair():
    base, rng = 0x123456789ABCDEF0, random.Random(4)
    fps = np.array(sorted({base ^ sum(1 << i for i in rng.sample(range(16), rng.randrange(9))) for _ in range(30_000)}), dtype=np.uint64)
    a, _, visited = forest(Tree(fps))
    print(f"{len(fps)} fingerprints, {visited} nodes visited, {visited / len(fps) ** 2:.3f} of all pairs")
    assert len(a) == len(fps) - 1 and visited < 0.15 * len(fps) ** 2


@pytest.mark.parametrize("many", [1, 1 << 25, 1 << 30])
def test_every_pair_within_the_radius_shares_a_home(many):
    chosen, rng = masks(many), random.Random(5)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for i in rng.sample(range(64), 3):
            b ^= 1 << i
        assert any(a & m == b & m for m in chosen)


@pytest.mark.parametrize("shard,largest,many", [(2048, 1 << 16, 0), (20, 1 << 16, 1 << 25), (60, 9, 0), (10, 9, 1 << 30)])
def test_links_in_shards_and_parts(spark, monkeypatch, shard, largest, many):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "LARGEST", largest)
    plan = masks(many)
    monkeypatch.setattr(simhash, "masks", lambda n: plan)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in _fps(6, flips=5))
    want = brute([f % (1 << 64) for f in signed])
    root = {r.node: r.root for r in components(links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    assert [signed.index(root.get(f, f)) for f in signed] == want


def test_documents(spark):
    rng = random.Random(7)
    rows = []
    for g in range(8):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 120))]
        for k in range(6):
            w = list(base)
            if k > 1:
                w[rng.randrange(len(w))] = f"e{k}"
            rows.append((g * 10 + k, " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One  Two"), (904, "one two"), (7, rows[30][1]), (None, rows[0][1]), (None, "nobody else has this")]
    got = near_duplicates(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, component_id string").repartition(4)).collect()
    fps = [plain(t) for _, t in rows]
    lab = brute(fps)
    least = {}
    for (d, _), c in zip(rows, lab):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    want = sorted(((d, f"{f:016x}", least.get(c)) for (d, _), f, c in zip(rows, fps, lab)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
