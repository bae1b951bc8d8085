"""Near duplicates by SimHash: documents whose 64-bit fingerprints differ in at most ``RADIUS`` bits, found in BK-trees.

1. A text's A-Z are lower-cased, its words are runs of bytes other than space and 0x09-0x0D, its shingles every three words in a row,
   repeats included, joined by spaces (fewer words: the whole sequence).  A bit of the fingerprint is 1 if it is set in over half of the
   shingles' XXH64 (seed 42).  Equal fingerprints collapse.
2. Of two fingerprints within the radius of 3, some of 4 blocks of 16 bits is equal (of 5 blocks two, of 6 blocks three, taken as the table
   grows).  For each choice of blocks, fingerprints go to shards by the hash of these bits, about ``SHARD`` to one: no
   link joins different shards only.
3. A shard's fingerprints form a BK-tree in flat arrays: a node's children are keyed by their integer Hamming distance to it, one each.  A
   query at distance d from a node follows only the edges from d - radius to d + radius.  Blocks of queries walk the tree together,
   and skip subtrees that lie wholly in the component they have reached.  So a dense group isn't compared pair by pair, and what a
   shard returns are the edges of a spanning forest.
4. A shard beyond ``LARGEST`` is dealt into parts with a tree each; each part's tree is then sent to every later part of its shard,
   whose fingerprints query it.  Trees go from task to task, never through the driver: together they hold all fingerprints.
5. Edges give components; a component's id is its least doc_id.

Null text or text without words: fingerprint zero, which links like any other.  A row with a null doc_id joins its
component, whose id comes from other rows (null if there are none).  Rows that repeat a doc_id each get their own text's result.
Ties: the least doc_id.  Texts of any length are taken whole.  An empty table gives none.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._store import written

RADIUS, SEED, WIDTH = 3, 42, 3
SHARD, LARGEST = 2048, 1 << 16  # fingerprints of a shard on average, and of a tree at most
VISITS = 2_000_000  # nodes that a block of queries visits at once, about
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, width: int = WIDTH, at_once: int = 100_000) -> int:
    """The unsigned 64-bit fingerprint of UTF-8 text."""
    words = text.translate(_LOWER).split()  # bytes split at exactly these six characters
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(starts), at_once):
        spans = zip(starts[i : i + at_once].tolist(), ends[i : i + at_once].tolist())
        h = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row."""

    def run(batches_in):
        for batch in batches_in:
            fps = np.array([fingerprint(t or b"") for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks(many: int) -> list[int]:
    """The bits that decide a fingerprint's shards, one mask for each way to choose blocks that may be the equal ones."""
    blocks = 4 if many <= 1 << 22 else 5 if many <= 1 << 28 else 6
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in itertools.combinations(parts, blocks - RADIUS)]


class Tree:
    """A BK-tree of distinct fingerprints in order of depth: ``fps``, ``edge`` (distance to the parent), ``parent``, ``child``.

    ``child[i, e]``: where the children of node i with edges of e or more start; ``child[i, 65]``: where its children end.
    """

    def __init__(self, fps: np.ndarray):
        n = len(fps)
        left, group = np.arange(n), np.zeros(n, dtype=np.int64)
        order, parents, edges, self.levels = [], [], [], [0]
        above, key = np.array([-1]), np.array([0])
        while len(left):
            heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))  # a group's first becomes its node
            base = self.levels[-1]
            order.append(left[heads])
            parents.append(above)
            edges.append(key)
            self.levels.append(base + len(heads))
            rest = np.ones(len(left), dtype=bool)
            rest[heads] = False
            node = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(left)))[rest]
            head = left[heads][node]
            left = left[rest]
            d = np.bitwise_count(fps[left] ^ fps[head]).astype(np.int64)
            to = node * 65 + d
            by = np.argsort(to, kind="stable")
            left, to = left[by], to[by]
            kinds, group = np.unique(to, return_inverse=True)
            above, key = base + kinds // 65, kinds % 65
        self.order = np.concatenate(order)
        self.fps, self.parent, self.edge = fps[self.order], np.concatenate(parents), np.concatenate(edges)
        keys = self.parent[1:] * 66 + self.edge[1:]
        self.child = (1 + np.searchsorted(keys, (np.arange(n)[:, None] * 66 + np.arange(66)[None, :]).ravel())).reshape(n, 66).astype(np.int32)

    def extremes(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest label of each subtree."""
        low, high = label.copy(), label.copy()
        for a, b in zip(self.levels[-2:0:-1], self.levels[:0:-1]):
            up = self.parent[a:b]
            first = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
            at = up[first]
            low[at] = np.minimum(low[at], np.minimum.reduceat(low[a:b], first))
            high[at] = np.maximum(high[at], np.maximum.reduceat(high[a:b], first))
        return low, high

    def within(self, queries: np.ndarray, radius: int = RADIUS, skip=None) -> tuple[np.ndarray, np.ndarray, int]:
        """(query, node) pairs within the radius, and how many nodes were visited; ``skip(query, node)`` marks subtrees to leave out."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
        found, visited = [], 0
        while len(q):
            if skip is not None:
                go = ~skip(q, node)
                q, node = q[go], node[go]
            visited += len(q)
            d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            found.append((q[near], node[near]))
            a, b = self.child[node, np.maximum(d - radius, 0)].astype(np.int64), self.child[node, np.minimum(d + radius + 1, 65)]
            many = np.maximum(b - a, 0)
            ends = np.cumsum(many)
            node = np.repeat(a - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)
            q = np.repeat(q, many)
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]), visited


def forest(tree: Tree, queries: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, int]:
    """Edges (a, b) between fingerprints that join what lies within the radius, and the number of visited nodes.

    Queries are the tree's own fingerprints, or others; then edges join these with the tree's and, through them, each other.
    """
    n = len(tree.fps)
    own = queries is None
    values = tree.fps if own else np.concatenate([tree.fps, queries])
    queries = tree.fps if own else queries
    label, first = np.arange(len(values)), 0 if own else n
    out_a, out_b, visited = [], [], 0
    low, high = tree.extremes(label[:n])
    step = max(16, min(512, VISITS // n))
    for i in range(0, len(queries), step):
        mine = label[first + i : first + i + step]
        q, node, seen = tree.within(queries[i : i + step], radius, lambda q, node: (low[node] == high[node]) & (low[node] == mine[q]))
        visited += seen
        x, y = mine[q], label[node]
        differ = x != y
        if not differ.any():
            continue
        pairs = np.unique(np.stack([np.minimum(x, y)[differ], np.maximum(x, y)[differ]]), axis=1)
        root = np.arange(len(values))
        while True:
            least = np.minimum(root[pairs[0]], root[pairs[1]])
            before = root.copy()
            np.minimum.at(root, root[pairs[0]], least)
            np.minimum.at(root, root[pairs[1]], least)
            root = root[root]
            if (root == before).all():
                break
        gone = np.flatnonzero(root != np.arange(len(values)))
        out_a.append(values[gone])
        out_b.append(values[root[gone]])
        label = root[label]
        low, high = tree.extremes(label[:n])
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b]), visited


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([none, none.cast(pa.int32()), pa.nulls(len(a), pa.binary()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["shard", "part", "fps", "a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """(a, b) fingerprints as longs: edges that join every two distinct ones within the radius into one component. ``fps``: fp, distinct, stored."""
    many = fps.count()
    shards = max(1, math.ceil(many / SHARD))
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks(many)]
    homes = F.array(*[F.lit(t * shards).cast("long") + F.pmod(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m).cast("long"))), F.lit(shards)) for t, m in enumerate(signed)])
    dealt = fps.select("fp", F.explode(homes).alias("shard"))
    large = written(dealt.groupBy("shard").count().where(F.col("count") > LARGEST).select("shard", F.ceil(F.col("count") / LARGEST).cast("int").alias("parts")), "simhash-large")
    split = not large.isEmpty()
    if split:  # at most one row for LARGEST fingerprints and choice of blocks
        parts = F.coalesce("parts", F.lit(1))
        dealt = dealt.join(F.broadcast(large) if large.count() <= 100_000 else large, "shard", "left").select("fp", "shard", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"), (parts > 1).alias("more"))
    else:
        dealt = dealt.select("fp", "shard", F.lit(0).alias("part"), F.lit(False).alias("more"))

    def run(batches_in):
        key, held = None, []

        def close():
            values = np.array(held, dtype=np.int64).view(np.uint64)
            a, b, _ = forest(Tree(np.sort(values)))
            yield _edges(a, b)
            if key[2]:
                yield pa.RecordBatch.from_pydict({"shard": [key[0]], "part": pa.array([key[1]], pa.int32()), "fps": [values.tobytes()], "a": pa.nulls(1, pa.int64()), "b": pa.nulls(1, pa.int64())})

        for batch in batches_in:
            for fp, *k in zip(*(batch.column(c).to_pylist() for c in ("fp", "shard", "part", "more"))):
                if k != key:
                    if len(held) > 1 or held and key[2]:
                        yield from close()
                    key, held = k, []
                held.append(fp)
        if len(held) > 1 or held and key[2]:
            yield from close()

    out = "shard long, part int, fps binary, a long, b long"
    found = written(dealt.repartition("shard", "part").sortWithinPartitions("shard", "part").mapInArrow(run, out), "simhash-links")
    edges = found.where("a IS NOT NULL").select("a", "b")
    if not split:
        return edges
    trees = found.where("fps IS NOT NULL").select("shard", "part", "fps")
    pairs = trees.join(trees.select("shard", F.col("part").alias("later"), F.col("fps").alias("queries")), "shard").where("part < later").select("fps", "queries")

    def across(batches_in):
        for batch in batches_in:
            for x, y in zip(batch.column("fps").to_pylist(), batch.column("queries").to_pylist()):
                a, b, _ = forest(Tree(np.sort(np.frombuffer(x, dtype=np.uint64))), np.frombuffer(y, dtype=np.uint64))
                yield _edges(a, b)

    spread = pairs.withColumn("__r", F.monotonically_increasing_id()).repartition("__r").select("fps", "queries")
    return edges.unionByName(written(spread.mapInArrow(across, out), "simhash-across").select("a", "b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    rows = written(fingerprints(docs), "simhash-rows")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fps")
    roots = components(links(fps.select("fp")), "simhash-components").withColumnRenamed("node", "fp")
    known = written(fps.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "simhash-roots")
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(known.join(ids, "root").select("fp", "component_id"), "simhash-ids")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
