"""Nearest neighbours by hierarchical navigable small-world graphs, one per shard.

A shard's distinct vectors become the nodes of one graph, stored as flat neighbour arrays in a file;
equal vectors share a node and keep their list of ids.  Nodes enter in blocks, those of the upper layers first: each
walks down the layers to its place, searches the graph of the nodes before it with a beam, and adds the earlier nodes of
its own block; links are then chosen by the usual diversity rule and pruned both ways.  A search walks the upper
layers greedily and layer 0 with a beam; a block of queries walks at once.  Every shard is searched for
every block of queries, and the shards' results are merged.  A row's shard follows from a hash of its id and vector, so
the same rows give the same graphs however they are stored.

Vectors that are null, empty, zero, of another length than most, or with a null or non-finite
component take no part.  Equal distances go to the smaller vec_id.  Rows that repeat a vec_id are
candidates of their own, but never neighbours of that vec_id; a query id that repeats asks once, with its least vector.
An empty table gives no rows.  Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import get_file, put_file, shared_dir, written

M = 16
BEAM_BUILD = 48
BEAM = 320
SPARE = 12  # links beyond a layer's most that wait for the next pruning
WALKERS = 256  # nodes or queries that walk at once
SHARD_BYTES = 16 << 20
QUERY_BLOCK = 1024


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=-1)[..., :, None] - 2 * (a @ np.swapaxes(b, -1, -2)) + (b * b).sum(axis=-1)[..., None, :]
    return np.maximum(d, 0, out=d)


def _diverse(x: np.ndarray, cand: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Per row of candidates (nearest first, -1 filled): those nearer to the node than to any chosen one; the nearest others fill up."""
    many, width = cand.shape
    if width <= most:
        return np.pad(cand, ((0, 0), (0, most - width)), constant_values=-1)
    here = cand >= 0
    v = x[cand]
    among = _squared(v, v)
    near, chosen, count = np.full((many, width), np.inf), np.zeros((many, width), dtype=bool), np.zeros(many, dtype=int)
    for i in range(width):
        take = here[:, i] & (count < most) & (dist[:, i] < near[:, i])
        chosen[take, i] = True
        count += take
        near[take] = np.minimum(near[take], among[take, i])
    order = np.argsort(np.where(chosen, 0, np.where(here, 1, 2)), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(cand, order, axis=1)


class Graph:
    """``links[l]``: neighbours on layer l as one flat int32 array, -1 filled. Layer l holds the first ``len(links[l])`` nodes."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray], ids: np.ndarray, ends: np.ndarray):
        self.x, self.links, self.ids, self.ends = vectors, links, ids, ends
        self.scale = float(np.abs(vectors).max(initial=0)) or 1.0
        self.w = vectors / self.scale  # distances among scaled and centred vectors neither overflow nor lose digits
        self.centre = np.median(self.w, axis=0) if len(vectors) else 0.0  # a mean would follow one far vector
        self.w -= self.centre
        self.norm = (self.w * self.w).sum(axis=1)
        self.evaluations = 0

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> "Graph":
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        mix = np.random.default_rng(11)
        turn = mix.permutation(len(first))  # insertion order must not follow the sort
        ends = np.append(first, len(ids))
        groups = [ids[ends[i] : ends[i + 1]] for i in turn.tolist()]
        n = len(first)
        level = np.sort(np.minimum((-np.log(1 - mix.random(n)) / math.log(M)).astype(int), 8))[::-1]
        graph = cls(vectors[first[turn]], [], np.concatenate(groups) if n else ids, np.cumsum([len(g) for g in groups]).astype(np.int64))
        for k in range(int(level.max(initial=0)), -1, -1):
            graph._insert(int((level >= k).sum()), 2 * M if k == 0 else M)
        return graph

    def _insert(self, n: int, most: int) -> None:
        """A new lowest layer of the first n nodes."""
        links = np.full((n, most + SPARE), -1, dtype=np.int32)
        above = len(self.links[0]) if self.links else 0
        lo = 0
        while lo < n:
            hi = min(n, lo + WALKERS, above if lo < above else n)
            block = np.arange(lo, hi)
            own = _squared(self.w[lo:hi], self.w[lo:hi])
            own[np.triu_indices(len(block))] = np.inf  # earlier nodes only
            cand, dist = np.broadcast_to(block, own.shape), own
            if lo:
                if lo < above:
                    up = self.links[0][lo:hi]
                    entry = np.where((up >= 0) & (up < lo), up, 0).max(axis=1)
                else:
                    entry = self._descend(self.w[lo:hi], 0)
                found, far = self._walk(links[:lo], self.w[lo:hi], entry, BEAM_BUILD)
                cand, dist = np.concatenate([found, cand], axis=1), np.concatenate([far + self.norm[lo:hi, None], dist], axis=1)
            links[lo:hi, :M] = self._best(cand, dist, M)
            self._link_back(links, lo, hi, most)
            lo = hi
        over = np.flatnonzero(links[:, most] >= 0)
        for at in np.array_split(over, max(1, len(over) // 512)):
            links[at, :most] = self._pruned(at, links[at], most)
        self.links.insert(0, np.ascontiguousarray(links[:, :most]))

    def _best(self, cand: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """The links chosen of each row's BEAM_BUILD nearest candidates; those at no finite distance are none."""
        by = np.argsort(dist, axis=1, kind="stable")[:, :BEAM_BUILD]
        near = np.take_along_axis(dist, by, axis=1)
        return _diverse(self.w, np.where(np.isfinite(near), np.take_along_axis(cand, by, axis=1), -1), near, most)

    def _pruned(self, nodes: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
        if not len(nodes):
            return cand[:, :most]
        dist = np.where(cand >= 0, self.norm[nodes][:, None] + self.norm[cand] - 2 * np.einsum("id,ijd->ij", self.w[nodes], self.w[cand]), np.inf)
        return self._best(cand, dist, most)

    def _link_back(self, links: np.ndarray, lo: int, hi: int, most: int) -> None:
        """Every chosen neighbour gets the link back; a full one is pruned to ``most``."""
        source, target = np.repeat(np.arange(lo, hi), M), links[lo:hi, :M].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        while len(target):  # as many of each node as fit; the rest in another turn
            heads = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            turn = np.arange(len(target)) - np.repeat(heads, np.diff(heads, append=len(target)))
            held = (links[target] >= 0).sum(axis=1)
            fits = held + turn < links.shape[1]
            links[target[fits], (held + turn)[fits]] = source[fits]
            source, target = source[~fits], target[~fits]
            full = np.unique(target)
            for at in np.array_split(full, max(1, len(full) // 512)):
                kept = self._pruned(at, links[at], most)
                links[at] = -1
                links[at, :most] = kept

    def _descend(self, q: np.ndarray, lowest: int) -> np.ndarray:
        """The node of each query at which layers down to ``lowest`` end."""
        at = np.zeros(len(q), dtype=np.int64)
        for links in self.links[: lowest - 1 if lowest else None : -1]:
            at = self._walk(links, q, at, 1)[0][:, 0]
        return at

    def _walk(self, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes found for each query from its entry, nearest first, and their distances less the query's norm."""
        many, n, each = len(q), len(links), max(1, beam // 12)
        kept, dist = np.full((many, beam), -1, dtype=np.int64), np.full((many, beam), np.inf)
        todo, seen = np.zeros((many, beam), dtype=bool), np.full(many * n, -1, dtype=np.int32)
        kept[:, 0], todo[:, 0] = entry, True
        seen[np.arange(many) * n + entry] = 0
        dist[:, 0] = self.norm[entry] - 2 * np.einsum("ij,ij->i", self.w[entry], q)
        live = np.arange(many)
        while True:
            waiting = todo[live]
            some = waiting.any(axis=1)
            live, waiting = live[some], waiting[some]
            if not len(live):
                return kept, dist
            row, col = np.nonzero(waiting & (np.cumsum(waiting, axis=1) <= each))  # the nearest few that are not yet expanded
            row = live[row]
            todo[row, col] = False
            near = links.take(kept[row, col], axis=0)
            at = (near + (row * n)[:, None])[near >= 0]
            at = at[seen.take(at) < 0]
            turn = np.arange(len(at), dtype=np.int32)
            seen[at] = turn
            row, near = np.divmod(at[seen.take(at) == turn], n)  # of a node that several links lead to, one
            self.evaluations += len(row)
            d = self.norm.take(near) - 2 * np.einsum("ij,ij->i", self.w.take(near, axis=0), q.take(row, axis=0))
            good = d < dist[row, -1]
            row, near, d = row[good], near[good], d[good]
            if not len(row):
                continue
            heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            count, own = np.diff(heads, append=len(row)), row[heads]
            place, col = np.repeat(np.arange(len(own)), count), beam + np.arange(len(row)) - np.repeat(heads, count)
            wide = np.pad(dist[own], ((0, 0), (0, int(count.max()))), constant_values=np.inf)
            nodes, fresh = np.pad(kept[own], ((0, 0), (0, wide.shape[1] - beam)), constant_values=-1), np.pad(todo[own], ((0, 0), (0, wide.shape[1] - beam)))
            wide[place, col], nodes[place, col], fresh[place, col] = d, near, True
            by = np.argsort(wide, axis=1, kind="stable")[:, :beam]
            dist[own], kept[own], todo[own] = (np.take_along_axis(z, by, axis=1) for z in (wide, nodes, fresh))

    def nearest(self, q: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """About the ``beam`` nearest nodes of each query, -1 filled."""
        if not len(self.x):
            return np.full((len(q), beam), -1, dtype=np.int64)
        out = []
        for i in range(0, len(q), WALKERS):
            w = q[i : i + WALKERS] / self.scale - self.centre
            out.append(self._walk(self.links[0], w, self._descend(w, 1), beam)[0])
        return np.concatenate(out)

    def search(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[float, int]]:
        """(exact distance, vec_id) of the k nearest rows found of one query."""
        return [(d, v) for _, d, v in self.search_block(np.array([query_id]), q[None], k)]

    def search_block(self, query_ids: np.ndarray, q: np.ndarray, k: int, beam: int = BEAM) -> list[tuple[int, float, int]]:
        """(query id, exact distance, vec_id) of each query's k nearest rows found, its own id left out; equal distances by vec_id."""
        out = []
        for i, x, nodes in zip(query_ids.tolist(), q, self.nearest(q, max(beam, k + 1))):
            nodes = nodes[nodes >= 0]
            exact = np.sqrt(((self.x[nodes] - x) ** 2).sum(axis=1))
            own: list[tuple[float, int]] = []
            for at in np.argsort(exact, kind="stable").tolist():
                if len(own) >= k and exact[at] > own[-1][0]:
                    break
                node = nodes[at]
                ids = self.ids[self.ends[node - 1] if node else 0 : self.ends[node]]
                own += [(float(exact[at]), v) for v in ids[ids != i][:k].tolist()]
            out += [(i, d, v) for d, v in sorted(own)[:k]]
        return out

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.x, ids=self.ids, ends=self.ends, layers=len(self.links), **{f"links{i}": r for i, r in enumerate(self.links)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Graph":
        z = np.load(io.BytesIO(raw))
        return cls(z["x"], [z[f"links{i}"] for i in range(int(z["layers"]))], z["ids"], z["ends"])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    good = v.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)).where(finite & F.exists("vector", lambda c: c != 0))
    size = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("vector") == (size["n"] if size else 0))


def _arrays(batches_in) -> tuple[np.ndarray, np.ndarray]:
    ids, flat, width = [], [], 0
    for b in batches_in:
        if b.num_rows:
            ids.append(b.column("vec_id").to_numpy())
            flat.append(b.column("vector").flatten().to_numpy().reshape(b.num_rows, -1))
    return (np.concatenate(ids), np.concatenate(flat)) if ids else (np.zeros(0, np.int64), np.zeros((0, width)))


def build_index(vectors: DataFrame, shard_rows: int | None = None) -> DataFrame:
    """Writes one graph file per shard and returns the manifest (shard, path, rows). ``vectors`` as from usable().

    A shard holds about ``SHARD_BYTES`` of vectors, or ``shard_rows``.
    """
    spark = vectors.sparkSession
    folder = shared_dir(spark, "hnsw")
    rows, size = vectors.agg(F.count("*"), F.sum(8 * F.size("vector"))).first()
    n = max(1, math.ceil(rows / shard_rows if shard_rows else (size or 0) / SHARD_BYTES))
    salted = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n)).cast("int"))

    def build(batches_in):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        ids, x = _arrays(batches_in)
        if len(ids):
            path = f"{folder}/{shard:08d}.graph"
            put_file(path, Graph.build(ids, x).to_bytes())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "rows": [len(ids)]})

    return written(salted.repartitionById(n, F.col("shard")).select("vec_id", "vector").mapInArrow(build, "shard int, path string, rows long"), "hnsw-manifest")


def search_index(manifest: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query against every shard, in blocks of queries; best k of all shards."""
    spark = manifest.sparkSession
    folder = shared_dir(spark, "hnsw-queries")
    once = written(queries.groupBy("vec_id").agg(F.min("vector").alias("vector")), "hnsw-asked")
    n = max(1, math.ceil(once.count() / QUERY_BLOCK))

    def store(batches_in):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        ids, x = _arrays(batches_in)
        if len(ids):
            out = io.BytesIO()
            np.savez(out, ids=ids, x=x)
            put_file(f"{folder}/{block:08d}.npz", out.getvalue())
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "file": [f"{folder}/{block:08d}.npz"]})

    numbered = once.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    blocks = written(numbered.repartitionById(n, F.col("block")).sortWithinPartitions("vec_id").select("vec_id", "vector").mapInArrow(store, "block int, file string"), "hnsw-blocks")
    todo = manifest.select("path", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block")).join(blocks, "block")

    def search(batches_in):
        last, graph = None, None
        for batch in batches_in:
            for row in batch.to_pylist():
                if row["path"] != last:
                    last, graph = row["path"], Graph.from_bytes(get_file(row["path"]))
                z = np.load(io.BytesIO(get_file(row["file"])))
                found = graph.search_block(z["ids"], z["x"], k)
                q, s, v = ([f[c] for f in found] for c in range(3))
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    tasks = max(1, min(todo.count(), 4096))
    found = todo.select("path", "file").repartition(tasks).sortWithinPartitions("path", "file").mapInArrow(search, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The k nearest of each vector whose id is divisible by ``every``."""
    good = written(usable(vectors), "hnsw-vectors")
    return search_index(build_index(good), good.where(F.pmod("vec_id", F.lit(every)) == 0), k)
