"""The prefix trie of rebuilt conversations, with subtree totals by parallel tree contraction.

1. Turns get their place in their conversation without one task that sees all of it: rows are dealt out by ranges of (conversation,
   turn), numbered within a range, and the count of earlier ranges is added.  Turns of equal number follow in order of
   a digest of their content.
2. A conversation c is rebuilt as the first h turns of conversation c - c % 5 and its own turns after its first h.
3. A turn's prefix has a 128-bit key: the exclusive or of hashes of (depth, SHA-256 of role and text) so far.  Long conversations are cut into
   chunks of ``CHUNK`` turns; keys are carried from chunk to chunk.  Each key's rows are checked to agree in their last
   turn and their parent's key, so that, from the root down, equal keys mean equal sequences; else an error is raised.
4. Grouped by key, the rows become nodes.
5. Subtree totals: rounds of joins on unique ids.  *Rake*: leaves hand their total to their parent and leave.  *Compress*: on each chain of nodes
   with one child, those of least rank among their neighbours leave; the child moves up and keeps what the edge to its new parent
   now stands for.  Ranks follow the lowest set bit of the depth, so regular chains halve; ties go by a hash that changes from round to round.
   Rounds grow with the logarithm of the number of nodes, not with the depth.  Then rounds are undone, last to first: the total
   of a compressed node is that of its child and what it recorded when it left.
6. The ids of the conversations that end at a node are hashed in ascending order, in pieces that different tasks have put together.

Rows with a null conv_id are dropped; a null turn comes first; null role or text is empty.  Rows that repeat are turns like any other.  A conversation
without rebuilt turns is a member of the root alone.  Texts of any length are taken whole.  Remainders have the sign of the
conversation's id.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import written

CHUNK = 1024
PIECE = 1 << 16  # ids in a piece
ROUNDS = 200
KEY = ["depth", "k1", "k2"]


def heads_of(conv: str):
    """How many turns a conversation takes from its base."""
    return F.pmod(F.crc32(F.col(conv).cast("string")), F.lit(9)).cast("int")


def placed(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest and bytes of every turn; a stored table."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).where("conv_id IS NOT NULL")
    order = [F.asc_nulls_first("turn"), F.asc("digest")]
    ranged = written(rows.repartitionByRange(F.asc("conv_id"), *order).withColumn("p", F.spark_partition_id()), "trie-ranges")
    counts = ranged.groupBy("conv_id", "p").count()
    before = Window.partitionBy("conv_id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.withColumn("before", F.sum("count").over(before)).where("before IS NOT NULL").select("conv_id", "p", "before")  # at most one row a range
    here = F.row_number().over(Window.partitionBy("p", "conv_id").orderBy(*order))
    numbered = ranged.withColumn("here", here).join(F.broadcast(carried), ["conv_id", "p"], "left")
    return written(numbered.select("conv_id", (F.coalesce("before", F.lit(0)) + F.col("here")).alias("place"), "digest", "bytes"), "trie-places")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, depth, digest, bytes, total) and conversations (conv_id, total). ``turns``: what ``placed`` gives."""
    sizes = written(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size")), "trie-sizes")
    base = F.col("conv_id") - F.col("conv_id") % 5
    own = sizes.select("conv_id", "size", heads_of("conv_id").alias("h"), base.alias("base"))
    taken = F.least("h", F.coalesce("base_size", F.lit(0)))
    joined = own.join(sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size")), "base", "left")
    plans = written(joined.select("conv_id", "base", "h", "size", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("size") - F.col("h"))).alias("total")), "trie-plans")
    first = turns.where("place <= 8").select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "digest", "bytes")
    front = plans.where("taken > 0").join(first, "base").where("depth <= h").select("conv_id", "depth", "digest", "bytes", "total")
    chunk = lambda c: F.floor(F.col(c) / CHUNK)
    spread = plans.select("conv_id", "h", "taken", "total", F.explode(F.sequence(F.lit(0).cast("long"), chunk("size"))).alias("chunk"))
    rest = turns.where(F.col("place") > heads_of("conv_id")).withColumn("chunk", chunk("place")).join(spread, ["conv_id", "chunk"])
    back = rest.select("conv_id", (F.col("taken") + F.col("place") - F.col("h")).alias("depth"), "digest", "bytes", "total")
    return written(front.unionByName(back), "trie-turns"), plans.select("conv_id", "total")


def keyed(turns: DataFrame) -> DataFrame:
    """``turns`` with the keys of the prefix that ends there (k1, k2) and of the one before (p1, p2)."""
    e1, e2 = (F.xxhash64(F.lit(salt), "depth", "digest") for salt in (1, 2))
    rows = turns.withColumn("e1", e1).withColumn("e2", e2).withColumn("chunk", F.floor(F.col("depth") / CHUNK))
    sums = rows.where(F.col("total") >= CHUNK).groupBy("conv_id", "chunk").agg(F.bit_xor("e1").alias("e1"), F.bit_xor("e2").alias("e2"))
    w = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("conv_id", "chunk", F.bit_xor("e1").over(w).alias("c1"), F.bit_xor("e2").over(w).alias("c2"))
    here = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    both = rows.join(carried, ["conv_id", "chunk"], "left").withColumn("k1", F.bit_xor("e1").over(here).bitwiseXOR(F.coalesce("c1", zero))).withColumn("k2", F.bit_xor("e2").over(here).bitwiseXOR(F.coalesce("c2", zero)))
    return both.select("conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("e2")).alias("p2"), "digest", "bytes", "total")


def nodes_of(members: DataFrame) -> DataFrame:
    """A row for each node with a number ``id``: its key, its parent's key, conv_id, n_convs and bytes; a stored table."""
    alike = (F.min("digest").eqNullSafe(F.max("digest"))) & (F.min("p1") == F.max("p1")) & (F.min("p2") == F.max("p2"))
    checked = F.when(alike, F.max("bytes")).otherwise(F.raise_error(F.lit("two prefixes share a key")).cast("long"))
    grouped = members.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), checked.alias("bytes"))
    return written(grouped.withColumn("id", F.monotonically_increasing_id()), "trie-nodes")


def ends_of(members: DataFrame) -> DataFrame:
    """The key of every node where conversations end, and the hash of their ids. ``members``: conv_id and key of the last prefix of each."""
    order = [*KEY, "conv_id"]
    ranged = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)

    def pieces(batches_in):
        key, ids = None, []

        def row():
            return pa.RecordBatch.from_pydict({**{c: pa.array([v], pa.int64()) for c, v in zip(KEY, key)}, "first": pa.array([ids[0]], pa.int64()), "piece": [",".join(map(str, ids)).encode()]})

        for batch in batches_in:
            for *k, c in zip(*(batch.column(x).to_pylist() for x in order)):
                if k != key or len(ids) >= PIECE:
                    if ids:
                        yield row()
                    key, ids = k, []
                ids.append(c)
        if ids:
            yield row()

    def hashed(batches_in):
        key, state = None, None

        def row():
            return pa.RecordBatch.from_pydict({**{c: pa.array([v], pa.int64()) for c, v in zip(KEY, key)}, "ends_sha256": [state.hexdigest()]})

        for batch in batches_in:
            for *k, piece in zip(*(batch.column(x).to_pylist() for x in (*KEY, "piece"))):
                if k == key:
                    state.update(b",")
                else:
                    if key is not None:
                        yield row()
                    key, state = k, hashlib.sha256()
                state.update(piece)
        if key is not None:
            yield row()

    names = ", ".join(f"{c} long" for c in KEY)
    cut = ranged.mapInArrow(pieces, f"{names}, first long, piece binary")
    return cut.repartition(*KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "piece").mapInArrow(hashed, f"{names}, ends_sha256 string")


def subtree_totals(tree: DataFrame, values: list[str], name: str = "trie") -> tuple[DataFrame, int]:
    """id and, for each of ``values``, its sum over the node's subtree, by rake and compress; and the number of rounds.

    ``tree``: id, parent (null at roots), depth, n_children and the values, a stored table.
    """
    edge = [f"e_{v}" for v in values]
    zero = F.lit(0).cast("long")
    active = tree.select("id", "parent", "depth", F.col("n_children").alias("left"), *values, *[zero.alias(e) for e in edge])
    raked, compressed = [], []
    for number in range(ROUNDS):
        raked.append(active.where("left = 0").select("id", *values))
        leaf = F.col("left") == 0
        sums = [F.sum(F.when(leaf, F.col(v) + F.col(e))).alias(f"s_{v}") for v, e in zip(values, edge)]
        kids = active.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.when(leaf, 1)).alias("gone"), F.max(F.when(~leaf, F.col("id"))).alias("heir"), *sums)
        grown = [(F.col(v) + F.coalesce(f"s_{v}", zero)).alias(v) for v in values]
        rest = written(active.where(~leaf).join(kids, "id", "left").select("id", "parent", "depth", (F.col("left") - F.coalesce("gone", zero)).alias("left"), "heir", *grown, *edge), f"{name}-raked")
        if rest.isEmpty():
            break
        rank = F.struct(F.col("depth").bitwiseAND(-F.col("depth")), F.xxhash64("id", F.lit(number)), "id")
        chain = rest.where("left = 1 AND parent IS NOT NULL").withColumn("rank", rank)
        beside = chain.select(F.col("id").alias("a"), F.col("rank").alias("ra"), "heir").join(chain.select(F.col("id").alias("heir"), F.col("rank").alias("rb")), "heir")
        stays = beside.select(F.when(F.col("ra") < F.col("rb"), F.col("heir")).otherwise(F.col("a")).alias("id"))
        leaves = written(chain.join(stays, "id", "left_anti").select("id", "parent", "heir", *[(F.col(v)).alias(f"l_{v}") for v in values], *[F.col(e).alias(f"l_{e}") for e in edge]), f"{name}-compressed")
        child = rest.select(F.col("id").alias("heir"), *edge)
        compressed.append(written(leaves.join(child, "heir").select("id", "heir", *[(F.col(f"l_{v}") + F.col(e)).alias(v) for v, e in zip(values, edge)]), f"{name}-records"))
        up = leaves.select(F.col("heir").alias("id"), F.col("parent").alias("up"), *[(F.col(f"l_{v}") + F.col(f"l_{e}")).alias(f"u_{v}") for v, e in zip(values, edge)])
        moved = rest.drop("heir").join(leaves.select("id"), "id", "left_anti").join(up, "id", "left")
        active = written(moved.select("id", F.coalesce("up", "parent").alias("parent"), "depth", "left", *values, *[(F.col(e) + F.coalesce(f"u_{v}", zero)).alias(e) for v, e in zip(values, edge)]), f"{name}-active")
    else:
        raise RuntimeError(f"the tree doesn't contract in {ROUNDS} rounds")
    known = raked[-1]
    for done, left in zip(raked[-2::-1], compressed[::-1]):
        totals = known.withColumnsRenamed({"id": "heir", **{v: f"t_{v}" for v in values}})
        known = known.unionByName(written(left.join(totals, "heir").select("id", *[(F.col(v) + F.col(f"t_{v}")).alias(v) for v in values]), f"{name}-expanded")).unionByName(done)
    return known, len(raked)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt(placed(conversations))
    zero = F.lit(0).cast("long")
    inner = keyed(turns)
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"), F.lit(None).cast("binary").alias("digest"), zero.alias("bytes"), "total")
    members = written(inner.unionByName(root), "trie-members")
    nodes = nodes_of(members)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.where("depth > 0").join(parents, ["depth", "p1", "p2"])
    kept = ["id", *KEY, "conv_id", "n_convs", "bytes", "parent", "parent_conv_id"]
    linked = written(below.select(*kept).unionByName(nodes.where("depth = 0").withColumn("parent", F.lit(None).cast("long")).withColumn("parent_conv_id", F.lit(None).cast("long")).select(*kept)), "trie-linked")
    many = linked.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = linked.join(many, "id", "left").withColumn("n_children", F.coalesce("n_children", zero))
    tree = written(tree.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes")), "trie-tree")
    totals, _ = subtree_totals(tree, ["n_leaves", "saved_tokens"])
    ends = ends_of(members.where("depth = total"))
    result = tree.drop("n_leaves", "saved_tokens").join(totals, "id").join(ends, KEY, "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return result.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
