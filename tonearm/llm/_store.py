"""Shared storage: tables that cut lineage, and plain files that executors write and read.

Everything lives under the folder the session names in ``spark.checkpoint.dir``.  Where that is unset, a
temporary folder takes its place in a local session; on a cluster that is an error.  Tables go through Spark's own
file systems; plain files (``put_file``, ``get_file``) through pyarrow's: local paths, hdfs, s3, gs and abfs addresses.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared one; the folder itself is made by its first writer."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tonearm-")
        base = _OWN[app]
    return f"{base.rstrip('/')}/tonearm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: survives lost executors, has no lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _fs(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + uri
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Writes under a name of its own, then moves: a reader never sees half a file."""
    fs, path = _fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(data)
    fs.move(part, path)


def open_file(uri: str):
    """A seekable binary reader."""
    fs, path = _fs(uri)
    return fs.open_input_file(path)


def get_file(uri: str) -> bytes:
    with open_file(uri) as f:
        return f.read()
