"""Change notification: a sink that records batches in a change log and leaves one marker for each new revision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tonearm.operators.changelog import ChangeLog
from tonearm.operators.changes import upserted


def notifying(log: ChangeLog, markers: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch's rows replace those of equal key; whoever watches ``markers`` sees a folder for each new revision.

    A batch that is repeated changes nothing in the log, so it finds the revision it made before and the marker that is there; if
    the first attempt ended between the two, the marker is written now.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates([log.key])
        rev = log.record(upserted(log.current().drop("rev"), rows, [log.key]))
        if rev > 1:
            log.spark.createDataFrame([(rev, number)], "rev long, batch long").coalesce(1).write.mode("ignore").parquet(f"{markers}/rev={rev}")

    return write


def notified(log: ChangeLog, markers: str) -> DataFrame:
    """(rev, changed, removed) of every revision that has been announced."""
    marked = log.spark.read.schema("batch long, rev long").option("basePath", markers).parquet(f"{markers}/rev=*").select("rev")
    return marked.join(log.commits().groupBy("rev").sum("changed", "removed").withColumnsRenamed({"sum(changed)": "changed", "sum(removed)": "removed"}), "rev")
