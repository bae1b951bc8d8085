"""Contiguous ranges of an integer key, without a sort of the whole table and without reading other columns first."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RANGES = 20_000


@dataclass(frozen=True)
class Ranges:
    """``firsts[i]`` is the smallest key of range ``nulls + i``; none of these is empty.

    Many rows with a null key are dealt evenly to the ranges below ``nulls``; a few (``nulls`` is 0) fall in range 0.
    Ranges are cut by places: keys counted from the least one, in steps of 2048 where they span more than 2**53, so
    that every place is a whole number that a double holds.
    """

    firsts: list[int]
    splits: list[float]
    nulls: int = 0
    base: int = 0
    wide: bool = False

    def __len__(self) -> int:
        return max(1, self.nulls + len(self.firsts))

    def place(self, key: Column) -> Column:
        return F.shiftright(key, 11) - (self.base >> 11) if self.wide else key - F.lit(self.base)

    def number(self, df: DataFrame, key: str, out: str) -> DataFrame:
        if self.nulls:
            known = Ranges(self.firsts, self.splits, 0, self.base, self.wide).number(df, key, out)
            return known.withColumn(out, F.when(F.col(key).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(self.nulls)).cast("int")).otherwise(F.col(out) + self.nulls))
        if len(self.splits) < 2:
            return df.withColumn(out, F.lit(0))
        cut = Bucketizer(splits=[-math.inf, *self.splits[1:], math.inf], inputCol="__k", outputCol="__b", handleInvalid="keep")
        placed = self.place(F.coalesce(F.col(key).cast("long"), F.lit(self.base))).cast("double")
        return cut.transform(df.withColumn("__k", placed)).withColumn(out, F.col("__b").cast("int")).drop("__k", "__b")


def ranges_of(df: DataFrame, key: str, rows_each: int) -> Ranges:
    """Ranges of about ``rows_each`` rows; only ``key`` is read. The driver gets two numbers a range, at most 20,000 ranges."""
    keys = df.select(F.col(key).cast("long").alias("k"))
    counted = keys.agg(F.count("k").alias("known"), F.count(F.lit(1)).alias("rows"), F.min("k").alias("least"), F.max("k").alias("most")).first()
    total, unknown = counted["known"], counted["rows"] - counted["known"]
    nulls = min(MAX_RANGES, math.ceil(unknown / rows_each)) if unknown > rows_each else 0
    n = max(1, min(MAX_RANGES, math.ceil(total / rows_each)))
    if total == 0:
        return Ranges([], [], nulls)
    empty = Ranges([], [], nulls, counted["least"], counted["most"] - counted["least"] >= 1 << 53)
    narrow = keys.where("k IS NOT NULL")
    at = [i / n for i in range(n)]
    got = narrow.select(empty.place(F.col("k")).alias("q")).agg(F.percentile_approx("q", at, max(10_000, 4 * n)).alias("q")).first()
    splits = sorted({0.0, *map(float, got["q"])})
    numbered = Ranges([0] * len(splits), splits, 0, empty.base, empty.wide).number(narrow, "k", "b")
    firsts = [r["m"] for r in numbered.groupBy("b").agg(F.min("k").alias("m")).orderBy("b").collect()]
    return Ranges(firsts, splits, nulls, empty.base, empty.wide)
