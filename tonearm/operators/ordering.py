"""Running totals and numbers over a whole table without one task that sees every row."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the one that the session names in ``spark.checkpoint.dir``.

    Where none is named, a local session takes a temporary folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="tonearm-")
    return f"{base.rstrip('/')}/tonearm/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: no lineage, computed once."""
    path = shared_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_total(df: DataFrame, order: list, value: Column, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over all rows up to this one in a total order.

    Rows are dealt out by ranges of the order and stored; each range is summed once, the sums of the ranges before
    are added to a running sum within the range.  Only one number per range meets in one place, which bounds the broadcast.
    """
    ranged = cut(df.withColumn("__v", value).repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sums = ranged.groupBy("__p").agg(F.sum("__v").alias("__s"))
    before = sums.select("__p", (F.sum("__s").over(Window.orderBy("__p")) - F.col("__s")).alias("__b"))
    here = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(before), "__p").withColumn(out, F.col("__b") + F.sum("__v").over(here)).drop("__p", "__v", "__b")


def numbered(df: DataFrame, order: list, out: str, base: int = 0) -> DataFrame:
    """Dense numbers in a total order."""
    return running_total(df, order, F.lit(1).cast("long"), out).withColumn(out, F.col(out) - 1 + base)
