"""Where queries register themselves with the SQL that states their result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.operators.textindex import TextIndex, built

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


_INDEXES: dict[tuple, TextIndex] = {}


class Tables:
    """The driver's tables by attribute; timestamps without zone become UTC timestamps."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @property
    def text_index(self) -> TextIndex:
        """The documents' search index: built once in an application for these files as they are now."""
        docs = self.spark.read.parquet(f"{self.dir}/documents.parquet")
        files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        state = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first()
        key = (self.spark.sparkContext.applicationId, self.dir, *state)
        if key not in _INDEXES:
            _INDEXES[key] = built(docs, "doc_id", "text")
        return _INDEXES[key]

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        for c, t in df.dtypes:
            if t == "timestamp_ntz":
                df = df.withColumn(c, df[c].cast("timestamp"))
        return df


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register
