"""State that follows an order within a key, for keys of any size.

A window needs all rows of a key in one task.  Where some key has more than ``ROWS_OF_A_TASK`` rows, these functions deal rows out
by ranges of (key, order) instead, work within each range, and hand a summary of each range on to the later ranges of the same key:
the last value for values carried forward, a sum for sums, a scaled map for recurrences.  As ranges are in order, a key that
spans two ranges is the first one of the later: so one summary a range at most is broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import cut

ROWS_OF_A_TASK = 2_000_000


def ranges(df: DataFrame, key: str) -> int:
    """Into how many ranges the rows should go; 0 where no key has more rows than one task should sort."""
    r = df.groupBy(key).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    return math.ceil(2 * r["all"] / ROWS_OF_A_TASK) if (r["most"] or 0) > ROWS_OF_A_TASK else 0


def _order(order: list) -> list[Column]:
    return [F.asc(c) if isinstance(c, str) else c for c in order]


def _handed_on(local: DataFrame, key: str, own: str, out: str, combine) -> DataFrame:
    """(__p, __k, out): for each range the combination of earlier ranges' values of its key. ``local``: a row for each range and key."""
    before = Window.partitionBy(key).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return local.select("__p", F.col(key).alias("__k"), combine(F.col(own)).over(before).alias(out), F.lag(F.lit(1)).over(Window.partitionBy(key).orderBy("__p")).alias("__s")).where("__s = 1").drop("__s")


def carried_forward(df: DataFrame, key: str, order: list, value: Column, out: str, own: bool = True) -> DataFrame:
    """``out``: the last non-null ``value`` among rows up to this one, or before it if not ``own``."""
    order, valued = _order(order), df.withColumn("__v", value)
    upto = lambda w, n: F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, n))
    many = ranges(df, key)
    if not many:
        return valued.withColumn(out, upto(Window.partitionBy(key).orderBy(*order), 0 if own else -1)).drop("__v")
    w = Window.partitionBy("__p", key).orderBy(*order)
    ranged = valued.repartitionByRange(many, F.asc(key), *order).withColumn("__p", F.spark_partition_id())
    local = cut(ranged.withColumn("__l", upto(w, 0 if own else -1)).withColumn("__e", upto(w, 0)).withColumn("__end", F.lead(F.lit(1)).over(w).isNull()))
    carry = _handed_on(local.where("__end"), key, "__e", "__c", lambda c: F.last(c, ignorenulls=True))
    joined = local.join(F.broadcast(carry), (local["__p"] == carry["__p"]) & local[key].eqNullSafe(carry["__k"]), "left")
    return joined.select(*[local[c] for c in df.columns], F.coalesce(local["__l"], carry["__c"]).alias(out))


def carried_sum(df: DataFrame, key: str, order: list, value: Column, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the key's rows before this one; 0 for the first."""
    order, valued = _order(order), df.withColumn("__v", value)
    before = lambda w: F.coalesce(F.sum("__v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    many = ranges(df, key)
    if not many:
        return valued.withColumn(out, before(Window.partitionBy(key).orderBy(*order))).drop("__v")
    ranged = cut(valued.repartitionByRange(many, F.asc(key), *order).withColumn("__p", F.spark_partition_id()))
    local = ranged.withColumn("__l", before(Window.partitionBy("__p", key).orderBy(*order)))
    carry = _handed_on(ranged.groupBy("__p", key).agg(F.sum("__v").alias("__s")), key, "__s", "__c", F.sum)
    joined = local.join(F.broadcast(carry), (local["__p"] == carry["__p"]) & local[key].eqNullSafe(carry["__k"]), "left")
    return joined.select(*[local[c] for c in df.columns], (local["__l"] + F.coalesce(carry["__c"], F.lit(0))).alias(out))


def _decayed(df: DataFrame, key: str, order: list, value: Column, factor: float, gather) -> DataFrame:
    """key, __x (``gather`` of values, each scaled by ``factor`` for every row after it), __n (rows) for each key.

    A range's rows become one map, x -> factor ** n * x + b or max(factor ** n * x, b); maps of a key compose by scaling each b by the
    rows of later ranges.
    """
    order = _order(order)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("__v", value).repartitionByRange(tasks, F.asc(key), *order).withColumn("__p", F.spark_partition_id())
    w = Window.partitionBy("__p", key).orderBy(*order)
    many = F.count(F.lit(1)).over(Window.partitionBy("__p", key))
    after = ranged.withColumn("__r", many - F.row_number().over(w))
    maps = cut(after.groupBy("__p", key).agg(gather(F.col("__v") * F.pow(F.lit(factor), F.col("__r"))).alias("__b"), F.count(F.lit(1)).alias("__n"), F.min_by("__v", -F.col("__r")).alias("__first")))
    later = Window.partitionBy(key).orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, -1)
    scaled = maps.withColumn("__s", F.pow(F.lit(factor), F.coalesce(F.sum("__n").over(later), F.lit(0))))
    return scaled.groupBy(key).agg(gather(F.col("__b") * F.col("__s")).alias("__x"), F.sum("__n").alias("__n"), F.min_by("__first", "__p").alias("__first"))


def moving_average(df: DataFrame, key: str, order: list, value: str, weight: float, out: str) -> DataFrame:
    """Per key the moving average in which a new value counts ``weight``; the first one starts it. Null values are left out."""
    known = df.where(F.col(value).isNotNull())
    keep = 1 - weight
    sums = _decayed(known, key, order, F.col(value).cast("double"), keep, F.sum)
    # the first value counts wholly: what the sum lacks of it is its share that the weight left out
    return sums.select(key, (F.col("__x") * weight + F.col("__first") * keep * F.pow(F.lit(keep), F.col("__n") - 1)).alias(out))


def held_peak(df: DataFrame, key: str, order: list, value: str, decay: float, out: str) -> DataFrame:
    """Per key the peak after its last row: the greater of each new absolute value and the decayed peak. Nulls only let it decay."""
    peaks = _decayed(df, key, order, F.abs(F.col(value)).cast("double"), decay, F.max)
    return peaks.select(key, F.coalesce("__x", F.lit(0.0)).alias(out))
