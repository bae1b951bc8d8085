"""A stored change log: rows and tombstones by revision, a counter that only goes up, deltas for replicas, compaction.

Layout below ``path`` (all tables, so that executors read and write them):

* ``commits/seq=n``: one row for each commit with its number, the revision after it, and how many rows it changed and removed.
  A commit counts once this row is there; what a broken-off commit left under its number is overwritten by the next one.
* ``rows/seq=n``: the rows that the commit wrote, each with the revision of its last shown change;
* ``gone/seq=n``: keys that it removed, with the revision;
* ``base/seq=n``: after a compaction, all rows as of that commit, in order of revision, and under ``stones/seq=n`` all tombstones.

A row takes a new revision only where a *shown* column changed (nulls are equal); other columns are stored under the old one.
A key that comes back loses its tombstone.  A log has one writer at a time.  Readers open the folders of later commits only: a delta of an old log costs what changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import cut, shared_folder

FULL_SHARE = 0.2


@dataclass(frozen=True)
class Delta:
    """How a replica catches up: ``kind`` is "full", "none" or "rows"; with "rows" come changed rows and removed keys."""

    kind: str
    catalogue_id: str
    rev: int
    changed: DataFrame | None = None
    removed: DataFrame | None = None


@dataclass(frozen=True)
class ChangeLog:
    spark: SparkSession
    path: str
    key: str
    schema: str  # of all rows, the key included
    shown: tuple[str, ...]

    @property
    def catalogue_id(self) -> str:
        return self.path.rsplit("-", 1)[1]

    @staticmethod
    def created(rows: DataFrame, key: str, shown: list[str]) -> "ChangeLog":
        """A new log whose first commit is ``rows``, at revision 1."""
        spark = rows.sparkSession
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        log = ChangeLog(spark, shared_folder(spark, "changes"), key, schema, tuple(shown))
        log._commit(1, 1, rows.withColumn("rev", F.lit(1).cast("long")), None)
        return log

    def _read(self, kind: str, schema: str, since: int) -> DataFrame:
        """Rows of one kind from commits after ``since``; only their folders are opened."""
        numbers = [r["seq"] for r in self.commits().where(F.col("seq") > since).select("seq").distinct().orderBy("seq").collect()]
        paths = [f"{self.path}/{kind}/seq={n}" for n in numbers]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commits(self) -> DataFrame:
        """seq, rev, base, changed and removed of every commit."""
        return self.spark.read.schema("seq long, rev long, base boolean, changed long, removed long").parquet(f"{self.path}/commits/*")

    def _head(self) -> tuple[int, int, int]:
        """The last commit, its revision, and the last commit with a base (0: none)."""
        r = self.commits().agg(F.max("seq").alias("seq"), F.max("rev").alias("rev"), F.max(F.when(F.col("base"), F.col("seq"))).alias("base")).first()
        return r["seq"], r["rev"], r["base"] or 0

    def _commit(self, seq: int, rev: int, rows: DataFrame, gone: DataFrame | None, base: bool = False) -> None:
        gone = gone if gone is not None else self.spark.createDataFrame([], self._gone_schema())
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/seq={seq}")
        gone.write.mode("overwrite").parquet(f"{self.path}/gone/seq={seq}")
        counts = [self.spark.read.parquet(f"{self.path}/{kind}/seq={seq}").count() for kind in ("rows", "gone")]
        self._mark(seq, rev, base, *counts)

    def _mark(self, seq: int, rev: int, base: bool, changed: int, removed: int) -> None:
        one = self.spark.createDataFrame([(seq, rev, base, changed, removed)], "seq long, rev long, base boolean, changed long, removed long")
        one.coalesce(1).write.parquet(f"{self.path}/commits/{seq:012d}-{'base' if base else 'rows'}")

    def _row_schema(self) -> str:
        return f"{self.schema}, rev long"

    def _gone_schema(self) -> str:
        kind = next(f.split("` ")[1] for f in self.schema.split(", ") if f.startswith(f"`{self.key}`"))
        return f"`{self.key}` {kind}, rev long"

    def revision(self) -> int:
        return self._head()[1]

    def current(self) -> DataFrame:
        """All rows as they are now, with their revision."""
        seq, _, base = self._head()
        late = self._latest(base)
        if not base:
            return late.where("NOT dead").select(*self.spark.createDataFrame([], self._row_schema()).columns)
        old = self.spark.read.schema(self._row_schema()).parquet(f"{self.path}/base/seq={base}")
        return old.join(late.select(self.key), self.key, "left_anti").select(*old.columns).unionByName(late.where("NOT dead").select(*old.columns))

    def _latest(self, since: int) -> DataFrame:
        """For each key that commits after ``since`` touched: its last row there, and ``dead``: whether it is gone now."""
        number = F.regexp_extract(F.col("_metadata.file_path"), "seq=([0-9]+)/", 1).cast("long").alias("seq")
        rows = self._read("rows", self._row_schema(), since)
        names = rows.columns
        rows = rows.select(*names, number) if rows.inputFiles() else rows.withColumn("seq", F.lit(0).cast("long"))
        gone = self._read("gone", self._gone_schema(), since)
        gone = gone.select(self.key, "rev", number) if gone.inputFiles() else gone.withColumn("seq", F.lit(0).cast("long"))
        both = rows.withColumn("dead", F.lit(False)).unionByName(gone.withColumn("dead", F.lit(True)), allowMissingColumns=True)
        last = both.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in names if c != self.key], "dead"), "seq").alias("r"))
        return last.select(self.key, "r.*").select(*names, "dead")

    def record(self, state: DataFrame) -> int:
        """Takes the table as it is now; returns the revision, which grows by one if any shown value, or the set of keys, changed."""
        seq, rev, _ = self._head()
        others = [c for c in state.columns if c != self.key]
        now = self.current().select(self.key, F.lit(True).alias("__o"), F.col("rev").alias("__rev"), *[F.col(c).alias(f"__{c}") for c in others])
        both = state.withColumn("__n", F.lit(True)).join(now, self.key, "full")
        same = lambda columns: F.forall(F.array(*[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns]), lambda x: x) if columns else F.lit(True)
        shown, known = same([c for c in others if c in self.shown]), F.col("__o") & F.col("__n")
        touched = cut(both.where(F.col("__o").isNull() | F.col("__n").isNull() | ~same(others)).withColumn("rev", F.when(known & shown, F.col("__rev")).otherwise(F.lit(rev + 1).cast("long"))))
        bumped = touched.where(F.col("rev") == rev + 1).limit(1).count()
        if touched.isEmpty():
            return rev
        self._commit(seq + 1, rev + bumped, touched.where("__n").select(*state.columns, "rev"), touched.where("__n IS NULL").select(self.key, "rev"))
        return rev + bumped

    def tombstones(self, since: int) -> DataFrame:
        """Keys removed after a revision that haven't come back, with the revision of their removal."""
        _, _, base = self._head()
        dead = self._latest(base).where("dead").select(self.key, "rev")
        if base:
            back = self._latest(base).select(self.key)
            dead = dead.unionByName(self.spark.read.schema(self._gone_schema()).parquet(f"{self.path}/stones/seq={base}").join(back, self.key, "left_anti"))
        return dead.where(F.col("rev") > since)

    def delta(self, catalogue_id: str | None, since: int, live: str = "true", copies: str = "false") -> Delta:
        """What changed after revision ``since`` of the log ``catalogue_id``.

        ``live``: which rows count as the table's size; ``copies``: rows that are reported as removed, not as changed.
        """
        seq, rev, base = self._head()
        if (catalogue_id is not None and catalogue_id != self.catalogue_id) or since > rev or since < 0:
            return Delta("full", self.catalogue_id, rev)
        if since == rev:
            return Delta("none", self.catalogue_id, rev)
        known = self.commits().where(F.col("rev") <= since).agg(F.max("seq")).first()[0] or 0
        if known >= base:  # later commits alone
            changed = self._latest(known).where("NOT dead").drop("dead").where(F.col("rev") > since)
        else:  # some were compacted: rows of the base know their revision
            changed = self.current().where(F.col("rev") > since)
        changed = cut(changed)
        many = changed.count()
        if many and many > FULL_SHARE * max(1, self.current().where(live).count()):
            return Delta("full", self.catalogue_id, rev)
        removed = self.tombstones(since).select(self.key).unionByName(changed.where(copies).select(self.key))
        return Delta("rows", self.catalogue_id, rev, changed.where(f"NOT coalesce({copies}, false)"), removed)

    def compacted(self) -> None:
        """Writes all rows and tombstones as of now; later readers open this and later commits."""
        seq, rev, _ = self._head()
        self.current().repartitionByRange("rev").sortWithinPartitions("rev").write.mode("overwrite").parquet(f"{self.path}/base/seq={seq}")
        self.tombstones(-1).write.mode("overwrite").parquet(f"{self.path}/stones/seq={seq}")
        self._mark(seq, rev, True, 0, 0)


def caught_up(replica: DataFrame, delta: Delta, key: str, log: ChangeLog, missing: str = "false") -> DataFrame:
    """The replica after a delta; a full one is taken anew.  Changed rows for which ``missing`` holds are deleted."""
    if delta.kind == "none":
        return replica
    if delta.kind == "full":
        return log.current().where(f"NOT ({missing})").select(*replica.columns)
    out = delta.removed.unionByName(delta.changed.select(key)).distinct()
    return replica.join(out, key, "left_anti").select(*replica.columns).unionByName(delta.changed.where(f"NOT ({missing})").select(*replica.columns))
