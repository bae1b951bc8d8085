"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import written


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long) but the roots; root is the component's least node.

    Each round moves edges to smaller ends and is stored, so rounds don't build on each other's plans;
    a hub's edges are summed before they are shuffled.  Rounds grow with the logarithm of the size; where
    ``most_rounds`` don't suffice, an error is raised.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = written(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), name)
    mark = _mark(now)
    if not mark[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct(), name)
        own = written(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(own, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(own.select("a", F.col("m").alias("b"))).distinct()
        now = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), name)
        last, mark = mark, _mark(now)
        if mark == last:
            break
    else:
        raise RuntimeError(f"components don't settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]
