"""A bounded, cancellable producer: a stored table as a stream of chunks, so many a trigger.

``staged`` writes the table as one file for each chunk, in order.  The stream's offset is the number of the next chunk; a trigger is
given at most ``per_trigger`` chunks, so a slow consumer holds the producer back.  Executors read the chunks.  A stopped query leaves its
offset in its checkpoint, and what was handed out is noted beside the chunks: started again, it goes on with the next one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tonearm.operators.ordering import shared_folder

SOURCE = "tonearm_chunks"
ROWS = 1_000_000


def staged(table: DataFrame, order: list | None = None, chunks: int | None = None, number: Column | None = None) -> str:
    """The folder of ``table`` in chunks: by ranges of ``order`` (about ``ROWS`` rows each, or so many), or by a given number from 0 to ``chunks`` - 1."""
    path = shared_folder(table.sparkSession, "chunks")
    if number is not None:
        parts = table.repartitionById(chunks, number.cast("int"))
    else:
        parts = table.repartitionByRange(chunks or max(1, math.ceil(table.count() / ROWS)), *order).sortWithinPartitions(*order)
    parts.write.parquet(path)
    return path


def _folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class _Chunks(DataSourceStreamReader):
    def __init__(self, schema: StructType, path: str, per_trigger: int):
        self.schema, self.path, self.per_trigger = schema, path, per_trigger

    def _files(self) -> list[str]:
        from pyarrow import fs

        store, folder = _folder(self.path)
        return sorted(f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("part-"))

    def initialOffset(self) -> dict:
        return {"chunk": 0}

    def latestOffset(self) -> dict:
        store, folder = _folder(self.path)
        note = f"{folder}/_handed_out"
        try:
            with store.open_input_file(note) as f:
                at = int(f.read().decode())
        except FileNotFoundError:
            at = 0
        at = min(at + self.per_trigger, len(self._files()))
        with store.open_output_stream(note, compression=None) as f:
            f.write(str(at).encode())
        return {"chunk": at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(f) for f in self._files()[start["chunk"] : end["chunk"]]]

    def read(self, partition: InputPartition):
        import pyarrow as pa
        import pyarrow.parquet as pq

        store, _ = _folder(self.path)
        target = to_arrow_schema(self.schema)
        with store.open_input_file(partition.value) as f:
            for batch in pq.ParquetFile(f, coerce_int96_timestamp_unit="us").iter_batches():
                yield from pa.Table.from_batches([batch]).select(target.names).cast(target, safe=False).to_batches()


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return self.options["columns"]

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Chunks(schema, self.options["path"], int(self.options.get("per_trigger", "1")))


def produced(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1) -> DataFrame:
    """The stream over a staged folder."""
    spark.dataSource.register(ChunkSource)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return spark.readStream.format(SOURCE).option("columns", columns).option("per_trigger", str(per_trigger)).load(path)
