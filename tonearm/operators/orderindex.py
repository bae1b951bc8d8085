"""An order kept with a table: any page of it reads one or two ranges, and the total is known without a count.

The table is stored once in ranges of the order, each sorted, with a manifest of how many rows come before each range.  Page n opens the
files of the ranges that it touches: the last page costs what the first one does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordering import shared_folder
from .relational import PER_PAGE_MOST, clamp

ROWS = 100_000


@dataclass(frozen=True)
class OrderIndex:
    spark: SparkSession
    path: str
    columns: tuple[str, ...]
    ascending: tuple[bool, ...]

    def _order(self) -> list[Column]:
        return [F.asc(f"__k{i}") if up else F.desc(f"__k{i}") for i, up in enumerate(self.ascending)]

    def manifest(self) -> DataFrame:
        """file, rows, and ``before``: how many rows precede the file's first one."""
        return self.spark.read.parquet(f"{self.path}/manifest")

    def total(self) -> int:
        return self.manifest().agg(F.sum("rows")).first()[0] or 0

    def rows(self, start: int, many: int) -> DataFrame:
        """The rows at places ``start`` (from 0) to ``start + many`` - 1, in order."""
        near = self.manifest().where((F.col("before") < start + many) & (F.col("before") + F.col("rows") > start)).orderBy("before").collect()
        if not near or many <= 0:
            return self.spark.read.parquet(f"{self.path}/rows").select(*self.columns).limit(0)
        found = self.spark.read.parquet(*[r["file"] for r in near])
        return found.orderBy(*self._order()).offset(start - near[0]["before"]).limit(many).select(*self.columns)

    def page(self, number: int = 1, per_page: int = 100) -> DataFrame:
        """One page, of 1 to 500 rows; -1 is all rows in order."""
        if per_page == -1:
            return self.spark.read.parquet(f"{self.path}/rows").orderBy(*self._order()).select(*self.columns)
        per_page = clamp(per_page, 1, PER_PAGE_MOST)
        return self.rows((max(1, number) - 1) * per_page, per_page)


def ordered(df: DataFrame, order: list[tuple[Column, bool]], rows: int = ROWS) -> OrderIndex:
    """Stores ``df`` in an order of (key, ascending) pairs; nulls come first where ascending, last where not. Ties must be broken by the last key."""
    index = OrderIndex(df.sparkSession, shared_folder(df.sparkSession, "order"), tuple(df.columns), tuple(up for _, up in order))
    keyed = df.select("*", *[key.alias(f"__k{i}") for i, (key, _) in enumerate(order)])
    keyed.repartitionByRange(max(1, math.ceil(df.count() / rows)), *index._order()).withColumn("__p", F.spark_partition_id()).sortWithinPartitions(*index._order()).write.parquet(f"{index.path}/rows")
    stored = index.spark.read.parquet(f"{index.path}/rows")
    counts = stored.groupBy("__p", F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    # a row for each range: about ``rows`` times fewer than the table has
    before = F.coalesce(F.sum("rows").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts.withColumn("before", before).drop("__p").coalesce(1).write.parquet(f"{index.path}/manifest")
    return index
