"""Data changes as data flow: each takes tables and returns the table as it is afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str], update=None) -> DataFrame:
    """``new`` rows replace ``old`` ones of the same key. ``update(column, old, new)`` may say otherwise per column."""
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.lit(True).alias("__o"), *[F.col(c).alias(f"__o_{c}") for c in rest])
    n = new.select(*keys, F.lit(True).alias("__n"), *[F.col(c).alias(f"__n_{c}") for c in rest])
    pick = update or (lambda c, a, b: b)
    both = F.col("__o").isNotNull() & F.col("__n").isNotNull()

    def value(c: str) -> Column:
        a, b = F.col(f"__o_{c}"), F.col(f"__n_{c}")
        return F.when(both, pick(c, a, b)).when(F.col("__n").isNotNull(), b).otherwise(a).alias(c)

    return o.join(n, keys, "full").select(*keys, *[value(c) for c in rest])


def inserted_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys))


def blanks_filled(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Only null columns take the new value."""
    n = new.select(key, *[F.col(c).alias(f"__n_{c}") for c in columns])
    return old.join(n, key, "left").select(*[F.coalesce(F.col(c), F.col(f"__n_{c}")).alias(c) if c in columns else F.col(c) for c in old.columns])


def really_changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New rows that differ from the old one in some column (nulls are equal), and rows that are new."""
    o = old.select(key, F.lit(True).alias("__o"), *[F.col(c).alias(f"__o_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__o_{c}"))
    return new.join(o, key, "left").where(F.col("__o").isNull() | ~same).select(*new.columns)


def marked_missing(known: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """``missing`` set for rows not seen in a scan; nothing is deleted."""
    s = seen.select(key).distinct().withColumn("__seen", F.lit(True))
    return known.join(s, key, "left").withColumn("missing", F.col("__seen").isNull()).drop("__seen")


def dropped_from_feed(stored: DataFrame, feed: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows that the feed no longer has; none if the feed came empty."""
    return stored.join(feed.select(*keys).distinct(), keys, "left_anti") if not feed.isEmpty() else stored.limit(0)


def scan_plan(known: DataFrame, files: DataFrame) -> DataFrame:
    """path and what a scan does with it: skip, update, add, or missing. Both sides: path, size, mtime; known also tagged."""
    k = known.select("path", F.lit(True).alias("__k"), F.col("size").alias("__s"), F.col("mtime").alias("__m"))
    f = files.select("path", F.lit(True).alias("__f"), "size", "mtime")
    same = F.col("size").eqNullSafe(F.col("__s")) & F.col("mtime").eqNullSafe(F.col("__m"))
    act = F.when(F.col("__f").isNull(), "missing").when(F.col("__k").isNull(), "add").when(same, "skip").otherwise("update")
    return k.join(f, "path", "full").select("path", act.alias("action"))


def change_feed(old: DataFrame, new: DataFrame, key: str, columns: list[str], rev: int) -> tuple[DataFrame, DataFrame]:
    """(changed rows with their revision, tombstones): a row counts as changed only if a listed column differs."""
    changed = really_changed(old, new, key, columns).withColumn("rev", F.lit(rev).cast("long"))
    gone = old.join(new.select(key), key, "left_anti").select(F.col(key).alias("id"), F.lit(rev).cast("long").alias("rev"))
    return changed, gone


def removed_rows(tombstones: DataFrame, tracks: DataFrame, since: int) -> DataFrame:
    """Ids gone since a revision: deleted ones and those that became copies, ascending."""
    gone = tombstones.where(F.col("rev") > since).select("id")
    copies = tracks.where((F.col("rev") > since) & F.col("duplicate_of").isNotNull()).select("id")
    return gone.unionByName(copies).orderBy("id")


def delta_kind(catalog_id: str, rev: int, asked_id: str | None, since: int, changed: int, total: int, share: float = 0.2) -> str:
    """"full", "none" or "rows": how a replica at ``since`` catches up. The share counts changed rows, not tombstones."""
    if (asked_id is not None and asked_id != catalog_id) or since > rev or since < 0:
        return "full"
    if since == rev:
        return "none"
    return "full" if changed > 0 and changed > share * max(total, 1) else "rows"


def delta_applied(replica: DataFrame, changed: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """The replica after a delta; changed rows flagged missing are deleted."""
    out = removed.select(F.col(removed.columns[0]).alias(key)).unionByName(changed.select(key)).distinct()
    return replica.join(out, key, "left_anti").unionByName(changed.where(~F.col("missing")).select(*replica.columns))


def played_marked(rows: DataFrame, ids: DataFrame, key: str, played: bool, now: int) -> DataFrame:
    """played_at set (the first time stays) or cleared for the listed rows."""
    i = ids.select(key).distinct().withColumn("__i", F.lit(True))
    value = F.coalesce("played_at", F.lit(now)) if played else F.lit(None).cast("long")
    return rows.join(i, key, "left").withColumn("played_at", F.when(F.col("__i"), value).otherwise(F.col("played_at"))).drop("__i")


def jobs_after_restart(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("status", F.when(F.col("status").isin("queued", "running"), "failed").otherwise(F.col("status")))


def got_or_created(names: DataFrame, wanted: DataFrame, next_id: int) -> DataFrame:
    """Rows of (id, name) with an id for every wanted name; new ids follow in name order."""
    from .ordering import numbered

    fresh = wanted.select("name").distinct().join(names, "name", "left_anti")
    return names.unionByName(numbered(fresh, ["name"], "id", next_id).select("id", "name"))


def cached_lookup(requests: DataFrame, cache: DataFrame, now: int, ttl_ms: int = 86_400_000) -> DataFrame:
    """Requests (key) with a cached body and whether it is fresh; a stale body stays usable when a refresh fails."""
    c = cache.select("key", "body", "fetched_at")
    return requests.join(c, "key", "left").withColumn("fresh", F.coalesce(F.col("fetched_at") >= now - ttl_ms, F.lit(False)))
