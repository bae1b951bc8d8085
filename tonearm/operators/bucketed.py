"""A stored table in buckets of its keys: merges, deletes and rebuilds that rewrite only what they touch.

A row's bucket is the hash of its keys.  A version is a manifest of one folder for each bucket.  A change finds the buckets of its rows first,
reads and rewrites these alone into folders of a new version, and then writes the manifest that swaps them in; until it is
there, readers see the version before.  Merging many rows joins them with their buckets on the bucket and the keys.  One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .changes import inserted_if_absent, upserted
from .ordering import shared_folder


@dataclass(frozen=True)
class BucketedTable:
    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int
    schema: str

    @staticmethod
    def created(df: DataFrame, keys: list[str], buckets: int = 64) -> "BucketedTable":
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        table = BucketedTable(df.sparkSession, shared_folder(df.sparkSession, "buckets"), tuple(keys), buckets, schema)
        table._swapped(1, df, {})
        return table

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        return self.spark.read.schema("version int, bucket int, folder string").parquet(f"{self.path}/manifest/*").agg(F.max("version")).first()[0]

    def folders(self) -> dict[int, str]:
        """Each bucket's folder in the present version; one entry a bucket."""
        rows = self.spark.read.schema("version int, bucket int, folder string").parquet(f"{self.path}/manifest/v{self.version():09d}").collect()
        return {r["bucket"]: r["folder"] for r in rows if r["folder"]}

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        return self._read(list(self.folders().values()))

    def _swapped(self, version: int, rows: DataFrame, kept: dict[int, str]) -> None:
        """Writes rows by bucket under a new version, and the manifest that has them beside the folders kept."""
        at = f"{self.path}/v{version:09d}"
        rows.withColumn("__b", self._bucket()).repartitionById(self.buckets, F.col("__b")).write.mode("overwrite").partitionBy("__b").parquet(at)
        new = {r["b"] for r in self.spark.read.schema(f"{self.schema}, `__b` int").option("basePath", at).parquet(at).select(F.col("__b").alias("b")).distinct().collect()}  # one a bucket
        entries = kept | {b: f"{at}/__b={b}" for b in new}
        self.spark.createDataFrame([(version, b, f) for b, f in entries.items()] or [(version, -1, None)], "version int, bucket int, folder string").coalesce(1).write.parquet(f"{self.path}/manifest/v{version:09d}")

    def touched(self, rows: DataFrame) -> list[int]:
        return sorted(r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect())

    def _changed(self, rows: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """Rewrites the buckets of ``rows``: ``change`` gives their new content from the old; returns how many."""
        now, which = self.folders(), self.touched(rows)
        if not which:
            return 0
        old = self._read([now[b] for b in which if b in now])
        self._swapped(self.version() + 1, change(old), {b: f for b, f in now.items() if b not in which})
        return len(which)

    def merged(self, rows: DataFrame, update=None) -> int:
        """Rows replace those of equal keys; ``update(column, old, new)`` may say otherwise. Keys repeat neither here nor there."""
        return self._changed(rows, lambda old: upserted(old, rows, list(self.keys), update))

    def inserted(self, rows: DataFrame) -> int:
        """Rows whose keys are absent."""
        return self._changed(rows, lambda old: inserted_if_absent(old, rows.select(*old.columns), list(self.keys)))

    def deleted(self, keys: DataFrame) -> int:
        return self._changed(keys, lambda old: old.join(keys.select(*self.keys).distinct(), list(self.keys), "left_anti"))

    def rebuilt(self, select: Callable[[DataFrame], DataFrame]) -> None:
        """The whole table anew from itself, in the same columns: all of it is written before it is swapped in."""
        old = self.rows()
        self._swapped(self.version() + 1, select(old).select(*old.columns), {})
