"""Composite catalogue jobs and the small state changes around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions import names, text

from . import analytic, changes
from .ordering import numbered


def stored_feed(episodes: DataFrame, feed_items: DataFrame) -> DataFrame:
    """Episodes after a feed was read: new ones added, known ones updated, ones the feed lost marked.

    ``episodes``: feed_id, guid, title, enclosure_url, file_path, dropped; ``feed_items``: feed_id, guid, title, enclosure_url.
    The address of a downloaded episode stays; a feed that came empty drops nothing.
    """
    new = feed_items.select("feed_id", "guid", "title", "enclosure_url", F.lit(None).cast("string").alias("file_path"), F.lit(False).alias("dropped"))

    def update(c: str, old: Column, fresh: Column) -> Column:
        if c == "enclosure_url":
            return F.when(F.col("__o_file_path").isNotNull(), old).otherwise(fresh)
        return old if c == "file_path" else fresh

    merged = changes.upserted(episodes, new, ["feed_id", "guid"], update)
    gone = changes.dropped_from_feed(episodes, feed_items, ["feed_id", "guid"]).select("feed_id", "guid", F.lit(True).alias("__gone"))
    return merged.join(gone, ["feed_id", "guid"], "left").withColumn("dropped", F.col("dropped") | F.coalesce("__gone", F.lit(False))).drop("__gone")


def to_download(episodes: DataFrame, feeds: DataFrame) -> DataFrame:
    """Of feeds that download by themselves: the newest ``keep_n`` unplayed episodes still in the feed that have no file yet."""
    own = episodes.join(feeds.where("auto_download").select("feed_id", "keep_n"), "feed_id").where("played_at IS NULL AND NOT dropped")
    newest = Window.partitionBy("feed_id").orderBy(F.desc_nulls_last("published_at"), F.desc("id"))
    return own.withColumn("__r", F.row_number().over(newest)).where((F.col("__r") <= F.greatest("keep_n", F.lit(1))) & F.col("file_path").isNull()).select("feed_id", "id")


def retention(episodes: DataFrame, feeds: DataFrame, now: int) -> DataFrame:
    """Ids whose files go: played longer ago than the feed allows, or beyond its newest N."""
    own = episodes.where("file_path IS NOT NULL").join(feeds, "feed_id")
    old = own.where(F.col("played_at") < F.lit(now) - F.col("delete_played_after_days").cast("long") * text.DAY_MS).select("id")
    order = [F.col("played_at").isNull(), F.coalesce("published_at", F.lit(0)), "id"]
    many = analytic.excess_beyond_newest(own.where("auto_download"), "feed_id", F.col("keep_n"), order).select("id")
    return old.unionByName(many).distinct()


def feed_list(feeds: DataFrame, episodes: DataFrame) -> DataFrame:
    """Feeds with all and unplayed episodes: one aggregation for both counts."""
    counts = episodes.groupBy("feed_id").agg(F.count("*").alias("episodes"), F.count_if(F.col("played_at").isNull() & ~F.col("dropped")).alias("unplayed"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("episodes", "unplayed")]
    return feeds.join(counts, "feed_id", "left").select(*feeds.columns, *zero)


def continue_shelf(books: DataFrame, positions: DataFrame, user: int) -> DataFrame:
    """Books begun, unfinished and not dismissed by a listener, latest first."""
    own = positions.where((F.col("user_id") == user) & ~F.col("dismissed") & (F.col("book_offset_ms") > 0))
    rows = books.join(own, "book_id").where(~text.finished(F.col("book_offset_ms"), F.col("duration_ms")))
    return rows.select("book_id", "book_offset_ms", text.progress(F.col("book_offset_ms"), F.col("duration_ms")).alias("progress"), "updated_at").orderBy(F.desc("updated_at"), "book_id")


def saved_positions(positions: DataFrame, updates: DataFrame) -> DataFrame:
    """Positions (book_id, user_id, book_offset_ms, updated_at, dismissed) after updates; only a move clears ``dismissed``."""
    new = analytic.latest_per_group(updates, ["book_id", "user_id"], [F.desc("updated_at")]).withColumn("dismissed", F.lit(False))

    def update(c: str, old: Column, fresh: Column) -> Column:
        return F.when(F.col("__o_book_offset_ms") == F.col("__n_book_offset_ms"), old).otherwise(fresh) if c == "dismissed" else fresh

    return changes.upserted(positions, new, ["book_id", "user_id"], update)


def patched_bookmarks(marks: DataFrame, patches: DataFrame) -> DataFrame:
    """Only given fields change; listed by offset."""
    p = patches.select("id", F.col("offset_ms").alias("__o"), F.col("note").alias("__t"))
    return marks.join(p, "id", "left").select("id", F.coalesce("__o", "offset_ms").alias("offset_ms"), F.coalesce("__t", "note").alias("note")).orderBy("offset_ms", "id")


def listeners(rows: DataFrame) -> DataFrame:
    """Listeners with their ``place`` from 1: the default one first, then by name without regard to ASCII case."""
    keyed = rows.withColumn("__d", ~F.col("is_default")).withColumn("__n", names.ascii_lower(F.col("name")))
    return numbered(keyed, ["__d", "__n", "id"], "place", 1).drop("__d", "__n")


def pending_again(albums: DataFrame) -> DataFrame:
    """Albums that were not found are looked up again, with fresh attempts."""
    lost = F.col("enrich_status") == "not_found"
    return albums.withColumn("enrich_attempts", F.when(lost, F.lit(0)).otherwise(F.col("enrich_attempts"))).withColumn("enrich_status", F.when(lost, F.lit("pending")).otherwise(F.col("enrich_status")))


def due_for_lookup(albums: DataFrame, attempts: int = 3) -> DataFrame:
    s = F.col("enrich_status")
    return albums.where((s == "pending") | ((s == "failed") & (F.col("enrich_attempts") < attempts)))


def still_on_disk(episodes: DataFrame, files: DataFrame) -> DataFrame:
    """file_path cleared where the file is gone."""
    f = files.select(F.col("path").alias("file_path")).distinct().withColumn("__f", F.lit(True))
    return episodes.join(f, "file_path", "left").withColumn("file_path", F.when(F.col("__f"), F.col("file_path"))).select(*episodes.columns)


def path_collisions(episodes: DataFrame) -> DataFrame:
    """Rows whose path another row has too."""
    return episodes.join(episodes.where("file_path IS NOT NULL").groupBy("file_path").count().where("count > 1").select("file_path"), "file_path", "left_semi")


def without_root(books: DataFrame, children: list[DataFrame], root: int) -> tuple[DataFrame, list[DataFrame]]:
    """A library root's books and all that hangs on them, deleted."""
    gone = books.where(F.col("root_id") == root).select("book_id")
    return books.where(F.col("root_id") != root), [c.join(gone, "book_id", "left_anti") for c in children]


def sorted_like_a_client(df: DataFrame, key: str, tie: str) -> DataFrame:
    """Order of a person's library view: base letters only, digit runs by value."""
    return df.orderBy(F.collate(names.natural_key(F.col(key)), "UNICODE_CI_AI"), tie)


def places_for_a_client(df: DataFrame, keys: list[str], tie: str, out: str = "place") -> DataFrame:
    """The place (from 1) of every row in a person's view, by several columns one after the other, without one task that sorts all."""
    sorts = {f"__s{i}": F.collate(names.natural_key(F.col(k)), "UNICODE_CI_AI") for i, k in enumerate(keys)}
    return numbered(df.withColumns(sorts), [*sorts, tie], out, 1).drop(*sorts)


def scanned(tracks: DataFrame, files: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tracks after a scan, counts per action). ``tracks``: path, size, mtime, title, album_id, hash, missing; ``files``: path, size, mtime; ``tags``: path, title, album_id, hash of files that were opened.

    Unchanged files keep their rows, changed and new ones take the new tags, vanished ones turn missing.
    """
    plan = changes.scan_plan(tracks, files)
    opened = plan.where("action IN ('add', 'update')").join(files, "path").join(tags, "path").select("path", "size", "mtime", "title", "album_id", "hash", F.lit(False).alias("missing"))
    kept = tracks.join(plan.where("action IN ('skip', 'missing')"), "path").select("path", "size", "mtime", "title", "album_id", "hash", (F.col("action") == "missing").alias("missing"))
    return kept.unionByName(opened), plan.groupBy("action").count()


def snapshot_json(rows: DataFrame, id_col: str) -> DataFrame:
    """One JSON document per row: what a replica stores."""
    return rows.select(F.col(id_col), F.to_json(F.struct(*rows.columns)).alias("json"))


def from_snapshot(docs: DataFrame, schema: str, required: str) -> DataFrame:
    """Rows of a replica's JSON documents; ones that can't be read are skipped."""
    return docs.select(F.from_json("json", schema).alias("r")).select("r.*").where(F.col(required).isNotNull())
