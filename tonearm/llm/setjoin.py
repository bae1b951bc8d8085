"""Exact similarity join of word-shingle sets: documents link where 100 * |A n B| >= 75 * |A u B|.

1. Every text becomes its set of 64-bit shingle hashes; equal sets (same 64-bit set hash) collapse.
   Each task also counts all shingles of its sets in ``CELLS`` cells by hash; the cells' sums over the whole corpus give an
   order of all shingles, those of full cells last, ties by hash.  Any order is right; this one keeps frequent passages
   out of prefixes, also those that no task sees twice.  A rare shingle in a full cell is only ordered late.
2. A set's prefix, in that order, holds a token of every set it can link with.  Prefix tokens go to
   buckets by hash, as packed arrays.  A bucket builds its index lists.  A list is cut into blocks of equal
   set size, each by position.  The earlier an entry lies in its set, the larger the sets it may link with: from each
   entry's size and position follows the last block that it reaches, and what lies beyond is skipped before any pair is built.
   Lists with up to ``LONG`` / 2 pairs an entry left give these pairs; longer ones only say which sets belong together
   (a chain along reached entries).  Pair counts are summed over buckets: of linked sets, at least as many prefix tokens
   meet within reach as their sizes imply.  What passes, with the chains, joins sets into candidate clusters; no link leaves one.
3. Each cluster's texts meet and overlaps are computed exactly.  A set without a similar leader becomes one and
   gets its overlaps from the index; a set similar to a leader derives its overlaps from the leader's, through the tokens
   in which the two differ.  A cluster beyond ``BLOCK_SHINGLES`` is cut into blocks that are joined each on its own, then
   the least set of every group found so meets others of its kind, and what is still outside the cluster's largest
   group meets everything, in pairs of blocks.  So copies in great number cost one pass; only the rest is sent out repeatedly.
4. Links give components; a component's id is its least doc_id.

Null or wordless text: size 0, linked with nothing.  A row with a null doc_id joins the component of
rows with an equal set, or has a null component_id.  Rows that repeat a doc_id each get a result; where their texts differ, a link
of either counts for both.  Copies are never expanded into pairs.  Texts of any length are taken whole.  Ties: a
component's least doc_id.  An empty table gives none.  Columns other than doc_id and text are ignored
(``deduplicated`` keeps them).  64-bit hashes stand for shingles and sets; no slack is kept for two that collide.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import mixed, release
from ._components import components
from ._shingles import shingles
from ._store import written

CELL_BITS, PART_BITS = 24, 16  # cells in which shingles are counted (a byte each in the order), and those of one summing row
CELLS = 1 << CELL_BITS
LONG = 64
BUCKET_POSTINGS = 1_500_000
PAIRS_AT_ONCE = 2_000_000
BLOCK_SHINGLES = 32_000
BROADCAST_ROWS = 1_000_000
_SALT = np.uint64(0x9FB21C651E98DF25)


def set_hash(s: np.ndarray) -> int:
    """One signed 64-bit hash of a set."""
    h = mixed(np.array([(mixed(s ^ _SALT).sum() if len(s) else np.uint64(0)) + np.uint64(len(s))], dtype=np.uint64))
    return int(h.view(np.int64)[0])


def prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _slices(batches_in, rows: int = 512):
    for batch in batches_in:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def counted(tokens: np.ndarray) -> list[dict]:
    """Rows with how many tokens fall in each cell: a row for each part of the cells, differences of cells and counts compressed."""
    cells, many = np.unique((tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64), return_counts=True)
    cuts = np.searchsorted(cells, np.arange(0, CELLS + 1, 1 << PART_BITS)).tolist()
    out = []
    for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            steps = np.diff(cells[a:b], prepend=part << PART_BITS).astype("<u4")
            out.append({"kind": 1, "n": part, "tokens": zlib.compress(steps.tobytes(), 1), "counts": zlib.compress(many[a:b].astype("<u4").tobytes(), 1)})
    return out


def summarised(docs: DataFrame, chunk: int = 2_000_000) -> DataFrame:
    """kind 0: doc_id, n (set size) and sid (set hash); kind 1: n (part of the cells) and what ``counted`` gives of a task's sets."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("sid", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary())])

    def run(batches_in):
        held, size, seen = [], 0, set()
        for part in _slices(batches_in):
            rows = []
            for doc, s in zip(part.column("doc_id").to_pylist(), shingles([t or "" for t in part.column("text").to_pylist()])):
                sid = set_hash(s)
                rows.append({"kind": 0, "doc_id": doc, "n": len(s), "sid": sid})
                if len(s) and sid not in seen:
                    seen.add(sid)
                    held.append(s)
                    size += len(s)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            if size > chunk:
                yield pa.RecordBatch.from_pylist(counted(np.concatenate(held)), schema=schema)
                held, size, seen = [], 0, set()
        if held:
            yield pa.RecordBatch.from_pylist(counted(np.concatenate(held)), schema=schema)
        held.clear()
        release()

    return _texts(docs).mapInArrow(run, "kind int, doc_id long, n int, sid long, tokens binary, counts binary")


def frequencies(summary: DataFrame) -> np.ndarray:
    """A byte for each cell: eighths of the binary logarithm of its count over the corpus. The driver gets ``CELLS`` bytes at most."""

    def run(batches_in):
        sums: dict[int, np.ndarray] = {}
        for batch in batches_in:
            for part, t, c in zip(*(batch.column(k).to_pylist() for k in ("n", "tokens", "counts"))):
                total = sums.setdefault(part, np.zeros(1 << PART_BITS, dtype=np.int64))
                total[np.cumsum(np.frombuffer(zlib.decompress(t), dtype="<u4"))] += np.frombuffer(zlib.decompress(c), dtype="<u4")
        for part, total in sums.items():
            classes = np.minimum(8 * np.log2(np.maximum(total, 1)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"n": pa.array([part], pa.int32()), "classes": pa.array([zlib.compress(classes.tobytes(), 1)], pa.binary())})

    tasks = min(CELLS >> PART_BITS, int(summary.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = summary.where("kind = 1").select("n", "tokens", "counts").repartitionById(tasks, F.pmod("n", F.lit(tasks))).mapInArrow(run, "n int, classes binary").collect()
    table = np.zeros(CELLS, dtype=np.uint8)
    for r in rows:
        table[r["n"] << PART_BITS : (r["n"] + 1) << PART_BITS] = np.frombuffer(zlib.decompress(r["classes"]), dtype=np.uint8)
    return table


class Order:
    """The total order of shingles: by the class of their cell, then by hash."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def prefix(self, s: np.ndarray, p: int) -> np.ndarray:
        """The first ``p`` of ascending tokens."""
        return s[np.argsort(self.table[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)], kind="stable")[:p]]


POSTINGS = "bucket int, sids binary, sizes binary, lost binary, many binary, tokens binary, places binary"


def _packed(values: np.ndarray, heads: np.ndarray) -> pa.Array:
    """One binary value for each run of ``values`` that starts at ``heads``."""
    ends = (np.append(heads, len(values)) * values.itemsize).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())])


def packed_postings(prefixes: list[np.ndarray], sids: list[int], sizes: list[int], buckets: int) -> pa.RecordBatch:
    """One row per bucket: its sets, how many tokens each has there, and these tokens' low halves and places.

    ``lost``: how many tokens of a set's prefix share bucket and low half with another one of it.
    """
    tok, n = np.concatenate(prefixes), np.array([len(x) for x in prefixes])
    doc = np.repeat(np.arange(len(n)), n)
    place = np.minimum(np.arange(len(tok)) - np.repeat(np.cumsum(n) - n, n), 65535).astype("<u2")
    bucket = ((tok >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    low = (tok & np.uint64(0xFFFFFFFF)).astype("<u4")
    same = np.lexsort((low, bucket, doc))
    twice = (doc[same][1:] == doc[same][:-1]) & (bucket[same][1:] == bucket[same][:-1]) & (low[same][1:] == low[same][:-1])
    lost = np.bincount(doc[same][1:][twice], minlength=len(n)).astype("<i4")
    by = np.argsort(bucket, kind="stable")  # a bucket's tokens stay in order of set
    bucket, owner = bucket[by], doc[by]
    new = np.ones(len(by), dtype=bool)
    new[1:] = bucket[1:] != bucket[:-1]
    starts = np.flatnonzero(new)
    new[1:] |= owner[1:] != owner[:-1]
    runs = np.flatnonzero(new)
    at, who = np.searchsorted(runs, starts), owner[runs]
    columns = [_packed(x[who], at) for x in (np.array(sids, dtype="<i8"), np.array(sizes, dtype="<i4"), lost)]
    columns += [_packed(np.diff(runs, append=len(by)).astype("<i4"), at), _packed(low[by], starts), _packed(place[by], starts)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), *columns], names=["bucket", "sids", "sizes", "lost", "many", "tokens", "places"])


def postings(docs: DataFrame, table: np.ndarray, buckets: int, flush: int = 1_500_000) -> DataFrame:
    """Prefix tokens packed by bucket; a task sends each distinct set once."""

    packed = zlib.compress(table.tobytes(), 1)

    def run(batches_in):
        order, seen = Order(np.frombuffer(zlib.decompress(packed), dtype=np.uint8)), set()
        pre, sids, sizes, total = [], [], [], 0
        for part in _slices(batches_in):
            for s in shingles([t or "" for t in part.column("text").to_pylist()]):
                sid = set_hash(s)
                if not len(s) or sid in seen:
                    continue
                seen.add(sid)
                pre.append(order.prefix(s, prefix_length(len(s))))
                sids.append(sid)
                sizes.append(len(s))
                total += len(pre[-1])
            if total > flush:
                yield packed_postings(pre, sids, sizes, buckets)
                pre, sids, sizes, total = [], [], [], 0
        if pre:
            yield packed_postings(pre, sids, sizes, buckets)
        pre.clear()
        release()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, POSTINGS)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of edges, as (node, root) pairs."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    lab = np.arange(len(nodes))
    x, y = ends[: len(a)], ends[len(a) :]
    while True:
        low = np.minimum(lab[x], lab[y])
        before = lab.copy()
        np.minimum.at(lab, lab[x], low)
        np.minimum.at(lab, lab[y], low)
        lab = lab[lab]
        if (lab == before).all():
            break
    own = np.flatnonzero(lab != np.arange(len(nodes)))
    return nodes[own], nodes[lab[own]]


def reached(tok, n, place):
    """For each entry of lists sorted by token, size and position: the end of the entries that it reaches.

    Sets x and y, x not larger, with an overlap of o >= need = ceil(3 (|x| + |y|) / 7) have their first need - ceil(3|y|/4) + 1
    common tokens at places p of x with |x| - p >= o - (need - ceil(3|y|/4)) >= ceil(3|y|/4).  So an entry needs no set
    larger than 4 (|x| - p) / 3: blocks of larger sets are skipped, and more of them the later the entry lies.
    """
    lists = np.cumsum(np.concatenate([[0], tok[1:] != tok[:-1]])).astype(np.int64) << 32
    return np.searchsorted(lists | n, lists | (4 * (n - place) // 3), side="right")


def list_pairs(tok, sid, n, place, lost):
    """Of one bucket: pairs within reach, in pieces, (a, b, shared, na, nb, first, slack); last the chain edges of long lists.

    ``first`` says whether some shared token lies early enough in both to be their first one in common, ``slack`` how many
    tokens two sets may share beyond those counted.
    """
    order = np.lexsort((sid, place, n, tok))
    tok, sid, n, place, lost = tok[order], sid[order], n[order], place[order], lost[order]
    starts = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
    size = np.diff(starts, append=len(tok))
    end = reached(tok, n, place)
    here = np.arange(len(tok))
    many = np.maximum(end - here - 1, 0)
    few = 2 * np.add.reduceat(many, starts) <= LONG * size
    own = np.repeat(few, size)
    x_all = here[own & (many > 0)]
    cuts = np.searchsorted(np.cumsum(many[x_all]), np.arange(PAIRS_AT_ONCE, int(many[x_all].sum()) + PAIRS_AT_ONCE, PAIRS_AT_ONCE), side="left") + 1
    for xs in np.split(x_all, np.unique(np.minimum(cuts, len(x_all)))):
        if not len(xs):
            continue
        k = many[xs]
        x = np.repeat(xs, k)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
        first = 7 * np.minimum(n[x] - place[x], n[y] - place[y]) >= 3 * (n[x] + n[y])
        flip = sid[x] > sid[y]
        a, b = np.where(flip, y, x), np.where(flip, x, y)
        by = np.lexsort((sid[b], sid[a]))
        a, b, first = a[by], b[by], first[by]
        heads = np.flatnonzero(np.concatenate([[True], (sid[a][1:] != sid[a][:-1]) | (sid[b][1:] != sid[b][:-1])]))
        a, b = a[heads], b[heads]
        yield sid[a], sid[b], np.diff(heads, append=len(by)), n[a], n[b], np.maximum.reduceat(first.astype(np.int64), heads), np.minimum(lost[a], lost[b])
    wide = np.where(own, 0, end)
    on = np.flatnonzero(np.maximum.accumulate(wide)[:-1] > here[1:])  # entries reach into their own list only
    yield _forest(sid[on], sid[on + 1]) if len(on) else (np.zeros(0, np.int64), np.zeros(0, np.int64))


PAIRS = ["a", "b", "shared", "na", "nb", "first", "slack"]


def candidate_edges(packed: DataFrame, buckets: int) -> DataFrame:
    """(a, b) set hashes that belong to one cluster."""

    def run(batches_in):
        cols = {k: [] for k in ("bucket", "sid", "n", "lost", "tok", "place")}
        for batch in batches_in:
            for r in batch.to_pylist():
                many = np.frombuffer(r["many"], dtype="<i4")
                cols["sid"].append(np.repeat(np.frombuffer(r["sids"], dtype="<i8"), many))
                cols["n"].append(np.repeat(np.frombuffer(r["sizes"], dtype="<i4"), many).astype(np.int64))
                cols["lost"].append(np.repeat(np.frombuffer(r["lost"], dtype="<i4"), many).astype(np.int64))
                cols["tok"].append(np.frombuffer(r["tokens"], dtype="<u4"))
                cols["place"].append(np.frombuffer(r["places"], dtype="<u2").astype(np.int64))
                cols["bucket"].append(np.full(int(many.sum()), r["bucket"], dtype=np.int64))
        if not cols["tok"]:
            return
        c = {k: np.concatenate(v) for k, v in cols.items()}
        key = (c["bucket"] << 32) | c["tok"].astype(np.int64)
        by = np.lexsort((c["place"], c["sid"], key))
        key, sid = key[by], c["sid"][by]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])])  # a set that several tasks sent
        by, key = by[fresh], key[fresh]
        same = key[1:] == key[:-1]
        multi = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        by, key = by[multi], key[multi]
        if not len(by):
            return
        for found in list_pairs(key, c["sid"][by], c["n"][by], c["place"][by], c["lost"][by]):
            for i in range(0, len(found[0]), 100_000):
                piece = [pa.array(x[i : i + 100_000], pa.int64()) for x in found]
                yield pa.RecordBatch.from_arrays(piece + [pa.nulls(len(piece[0]), pa.int64())] * (len(PAIRS) - len(piece)), names=PAIRS)

    found = written(packed.repartitionById(buckets, F.col("bucket")).mapInArrow(run, ", ".join(f"{c} long" for c in PAIRS)), "join-pairs")
    same = [F.first(c).alias(c) for c in ("na", "nb", "slack")]
    summed = found.where("shared IS NOT NULL").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("first").alias("first"), *same)
    need = F.ceil(F.lit(3) * (F.col("na") + F.col("nb")) / 7)
    least = F.greatest(F.lit(1), need - F.ceil(F.lit(3) * F.greatest("na", "nb") / 4) + 1 - F.col("slack"))
    passed = summed.where((F.col("first") == 1) & (F.col("shared") >= least)).select("a", "b")
    return passed.unionByName(found.where("shared IS NULL").select("a", "b"))


def join_cluster(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the least index of its component; overlaps of all pairs are computed exactly."""
    c = len(sets)
    lab = np.arange(c)
    if c < 2:
        return lab
    if c == 2:
        a, b = sets
        o = len(np.intersect1d(a, b, assume_unique=True))
        if 7 * o >= 3 * (len(a) + len(b)):
            lab[1] = 0
        return lab
    n = np.array([len(s) for s in sets], dtype=np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(c), n)
    _, token, many = np.unique(flat, return_inverse=True, return_counts=True)
    keep = many[token] > 1
    token, owner = token[keep], owner[keep]
    by = np.argsort(token, kind="stable")
    ids, token_sorted = np.unique(token, return_inverse=True)[0], token[by]
    lists = np.split(owner[by], np.flatnonzero(token_sorted[1:] != token_sorted[:-1]) + 1) if len(by) else []
    place = np.searchsorted(ids, token)
    cuts = np.searchsorted(owner, np.arange(1, c))
    own = np.split(place, cuts)  # ascending within each set, as sets are
    leader = np.full(c, -1)
    answers: dict[int, np.ndarray] = {}
    left = {}
    for x in np.argsort(-n, kind="stable").tolist():
        r = int(leader[x])
        if r < 0:
            over = np.zeros(c, dtype=np.int32)
            for t in own[x].tolist():
                over[lists[t]] += 1
            follow = np.flatnonzero((leader < 0) & (2 * over.astype(np.int64) >= n + n[x] - over))  # resemblance of a half
            follow = follow[follow != x]
            leader[follow] = leader[x] = x
            if len(follow):
                answers[x], left[x] = over, len(follow)
        else:
            over = answers[r].copy()
            for t in np.setdiff1d(own[r], own[x], assume_unique=True).tolist():
                over[lists[t]] -= 1
            for t in np.setdiff1d(own[x], own[r], assume_unique=True).tolist():
                over[lists[t]] += 1
            left[r] -= 1
            if not left[r]:
                del answers[r]
        linked = np.unique(lab[(7 * over.astype(np.int64) >= 3 * (n + n[x])) & (n > 0)])
        if len(linked) > 1:
            lab[np.isin(lab, linked)] = linked[0]
    return lab


def linked_within(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """(a, b) doc_ids that link within a job, as spanning forests. ``jobs``: doc_id, cluster, i, j, a row for each job of a document."""
    todo = written(jobs.select("doc_id", "cluster", "i", "j"), "join-jobs")
    small = todo.count() <= BROADCAST_ROWS
    texts = _texts(docs).where("doc_id IS NOT NULL AND text IS NOT NULL").join(F.broadcast(todo) if small else todo, "doc_id")
    dealt = texts.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "doc_id")

    def close(ids, texts_):
        out = [shingles(texts_[k : k + 256]) for k in range(0, len(texts_), 256)]
        lab = join_cluster([s for p in out for s in p])
        return [(ids[i], ids[r]) for i, r in enumerate(lab.tolist()) if i != r and ids[i] != ids[r]]

    def run(batches_in):
        key, ids, held, edges = None, [], [], []
        for batch in batches_in:
            for doc, text, *k in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "cluster", "i", "j"))):
                if k != key:
                    edges += close(ids, held) if len(ids) > 1 else []
                    key, ids, held = k, [], []
                ids.append(doc)
                held.append(text)
            if len(edges) > 50_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})
                edges = []
        edges += close(ids, held) if len(ids) > 1 else []
        if edges:
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return written(dealt.select("doc_id", "text", "cluster", "i", "j").mapInArrow(run, "a long, b long"), "join-links")


def _blocks(total: str):
    return F.ceil(F.col(total) / BLOCK_SHINGLES).cast("int")


def _dealt(parts: str, salt: int):
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(parts)).cast("int")


def verified_links(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b) doc_ids that link, as spanning forests. ``members``: doc_id, cluster, n; a stored table."""
    sums = written(members.groupBy("cluster").agg(F.sum("n").alias("t")).select("cluster", _blocks("t").alias("parts")), "join-sums")
    block = _dealt("parts", 0)
    links = linked_within(docs, members.join(sums, "cluster").select("doc_id", "cluster", block.alias("i"), block.alias("j")))
    large = members.join(sums.where("parts > 1"), "cluster").select("doc_id", "cluster", "n")
    if large.isEmpty():
        return links

    def grouped(found, name):
        roots = components(found, name).withColumnRenamed("node", "doc_id")
        return written(large.join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), name)

    heads = grouped(links, "join-groups").where("root = doc_id")
    many = heads.groupBy("cluster").agg(F.sum("n").alias("t")).select("cluster", _blocks("t").alias("parts"))
    block = _dealt("parts", 1)
    links = links.unionByName(linked_within(docs, heads.join(many, "cluster").select("doc_id", "cluster", block.alias("i"), block.alias("j"))))
    now = grouped(links, "join-groups")
    groups = now.groupBy("cluster", "root").agg(F.sum("n").alias("t"))
    main = groups.groupBy("cluster").agg(F.max_by("root", F.struct("t", "root")).alias("main"), F.max("t").alias("tm"), (F.sum("t") - F.max("t")).alias("tr")).where("tr > 0")
    split = now.join(main.select("cluster", "main", _blocks("tm").alias("pm"), _blocks("tr").alias("pr")), "cluster")
    if split.isEmpty():
        return links
    rest = split.where("root <> main").withColumn("r", _dealt("pr", 2))
    spread = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    core = split.where("root = main").select("doc_id", "cluster", _dealt("pm", 2).alias("i"), spread("pr").alias("j"))
    beside = rest.select("doc_id", "cluster", spread("pm").alias("i"), F.col("r").alias("j"))
    others = F.filter(F.sequence(F.lit(0), F.col("pr") - 1), lambda q: q != F.col("r"))  # a block with itself has met beside the core
    among = rest.select("doc_id", "cluster", "r", F.explode(others).alias("q")).select("doc_id", "cluster", (-1 - F.least("r", "q")).alias("i"), F.greatest("r", "q").alias("j"))
    return links.unionByName(linked_within(docs, core.unionByName(beside).unionByName(among)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    summary = written(summarised(docs), "join-sets")
    sets = summary.where("kind = 0").select("doc_id", "n", "sid")
    reps = written(sets.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "join-reps")
    total = reps.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, math.ceil(0.26 * total / BUCKET_POSTINGS))
    edges = written(candidate_edges(postings(docs, frequencies(summary), buckets), buckets), "join-edges")
    named = reps.where("rep IS NOT NULL").select("sid", "rep")
    ends = edges.join(named.withColumnsRenamed({"sid": "a", "rep": "ra"}), "a").join(named.withColumnsRenamed({"sid": "b", "rep": "rb"}), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    clusters = components(ends, "join-clusters")
    inside = clusters.select(F.col("node").alias("rep"), F.col("root").alias("cluster")).unionByName(clusters.select(F.col("root").alias("rep"), F.col("root").alias("cluster")).distinct())
    members = written(inside.join(reps.select("rep", "n"), "rep").select(F.col("rep").alias("doc_id"), "cluster", "n"), "join-members")
    found = components(verified_links(docs, members), "join-components")
    ids = written(reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("sid", F.coalesce("root", "rep").alias("component_id")), "join-ids")
    whole = sets.where("n > 0").join(ids, "sid").select("doc_id", "n", "component_id")
    return whole.unionByName(sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every component: that of least doc_id. Wordless rows and rows with a null doc_id stay.

    Texts don't move where the dropped ids fit a broadcast; beyond ``BROADCAST_ROWS`` they are joined by a shuffle.
    """
    ids = written(near_duplicates(docs).select("doc_id", "n_shingles", "component_id"), "join-result")
    gone = written(ids.where("doc_id IS NOT NULL AND doc_id <> component_id").select("doc_id").distinct(), "join-gone")
    again = written(ids.where("doc_id = component_id AND n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id"), "join-again")
    side = lambda t: F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
    kept = docs.join(side(gone), "doc_id", "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    twice = side(again)
    kept = kept.select(*docs.columns)
    return kept.join(twice, "doc_id", "left_anti").unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*docs.columns)
