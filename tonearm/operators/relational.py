"""Browsing a catalogue: visibility rules, joins to children, as-of and interval lookups, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions.names import ascii_lower

from .carried import carried_forward

PER_PAGE_MOST = 500


# Visibility rules; queries combine them differently.
def present(missing: Column) -> Column:
    return ~missing


def not_a_copy(duplicate_of: Column) -> Column:
    return duplicate_of.isNull()


def is_music(kind: Column) -> Column:
    return kind == "music"


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(high, n))


def page(df: DataFrame, order: list, number: int = 1, per_page: int = 100) -> DataFrame:
    """One page of rows in a total order; per_page -1 is all rows."""
    if per_page == -1:
        return df.orderBy(*order)
    per_page = clamp(per_page, 1, PER_PAGE_MOST)
    return df.orderBy(*order).offset((max(1, number) - 1) * per_page).limit(per_page)


def page_with_child_count(parents: DataFrame, order: list[str], number: int, per_page: int, children: DataFrame, key: str, child_key: str, out: str) -> DataFrame:
    """A page of parents, each with its count of children: the page is taken first, so only its few rows' children are counted."""
    rows = page(parents, order, number, clamp(per_page, 1, PER_PAGE_MOST)).collect()  # 500 at most
    first = parents.sparkSession.createDataFrame(rows, parents.schema)
    theirs = children.join(F.broadcast(first.select(F.col(key).alias(child_key))), child_key, "left_semi")
    return with_child_count(first, theirs, key, child_key, out).orderBy(*order)


def page_after(df: DataFrame, key: str, after, n: int) -> DataFrame:
    """Keyset page: rows beyond ``after``, so no page costs more than the first."""
    return df.where(F.col(key) > after).orderBy(key).limit(n)


def no_case(c: Column) -> Column:
    """Sort key of a collation that ignores ASCII case."""
    return ascii_lower(c)


def with_child_count(parents: DataFrame, children: DataFrame, key: str, child_key: str, out: str) -> DataFrame:
    """A count of children per parent, 0 where there are none: summed before it is joined."""
    counts = children.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias(out))
    return parents.join(counts, key, "left").withColumn(out, F.coalesce(out, F.lit(0)).cast("long"))


def first_per_group(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def left_join_first(parents: DataFrame, children: DataFrame, key: str, order: list) -> DataFrame:
    """Each parent with its first child, or nulls: the least row of each key, taken before the shuffle. ``order``: column names."""
    rest = [c for c in children.columns if c != key]
    first = children.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__c")).select(key, "__c.*")
    return parents.join(first, key, "left")


def starting_at_or_before(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, tie: str, keep: list[str]) -> DataFrame:
    """As-of join: for each point the span of the same key with the greatest start not after it, ties to the greatest tie column.

    Both sides are sorted once by (key, time) and the last span carried forward: no range join, no pair is built.
    """
    value = F.struct(*[F.col(c).alias(c) for c in keep])
    p = points.select(F.struct(*points.columns).alias("__row"), F.col(key).alias("__key"), F.col(at).alias("__t"), F.lit(1).alias("__is"), F.lit(None).cast("long").alias("__tie"))
    s = spans.select(F.lit(None).cast(p.schema["__row"].dataType).alias("__row"), F.col(key).alias("__key"), F.col(start).alias("__t"), F.lit(0).alias("__is"), F.col(tie).cast("long").alias("__tie"), value.alias("__span"))
    both = p.withColumn("__span", F.lit(None).cast(s.schema["__span"].dataType)).unionByName(s)
    found = carried_forward(both, "__key", ["__t", "__is", "__tie"], F.col("__span"), "__found").where("__is = 1")
    return found.select("__row.*", *[F.col(f"__found.{c}").alias(f"found_{c}") for c in keep])


def resolve_offset(points: DataFrame, parts: DataFrame) -> DataFrame:
    """(book_id, x) to (part_index, within): the first part with x < start + duration; past the end, the last part at its duration.

    ``parts``: book_id, part_index, start_offset_ms, duration_ms, ends rising with part_index.  Points and ends are sorted once, latest first,
    and the nearest end after a point is carried to it; a book's last part comes before all of its points.
    """
    x = F.greatest(F.col("x"), F.lit(0)).cast("long")
    part = lambda over: F.struct(F.col("part_index").cast("long").alias("part_index"), F.col("start_offset_ms").cast("long").alias("start"), F.col("duration_ms").cast("long").alias("duration"), F.lit(over).alias("over"))
    row, book, none = F.struct(*points.columns), F.col("book_id").alias("__key"), F.lit(None).cast("long").alias("__i")
    p = points.select(row.alias("__row"), book, x.alias("__t"), F.lit(1).alias("__is"), none)
    s = parts.select(book, (F.col("start_offset_ms") + F.col("duration_ms")).cast("long").alias("__t"), F.lit(2).alias("__is"), F.col("part_index").cast("long").alias("__i"), part(False).alias("__part"))
    last = parts.groupBy("book_id").agg(F.max_by(part(True), "part_index").alias("__part")).select(book, F.lit((1 << 63) - 1).alias("__t"), F.lit(0).alias("__is"), none, "__part")
    rows = p.unionByName(s, allowMissingColumns=True).unionByName(last, allowMissingColumns=True)
    # an end equal to a point isn't after it, so points come before ends; of equal ends the first part comes last
    found = carried_forward(rows, "__key", [F.desc("__t"), "__is", F.desc("__i")], F.col("__part"), "__hit").where("__is = 1 AND __hit IS NOT NULL")
    within = F.when(F.col("__hit.over"), F.col("__hit.duration")).otherwise(F.greatest(F.col("__t") - F.col("__hit.start"), F.lit(0)))
    return found.select("__row.*", F.col("__hit.part_index").alias("part_index"), within.alias("within_ms"))


def in_input_order(ids: DataFrame, table: DataFrame, key: str, position: str = "pos") -> DataFrame:
    """Rows for a list of ids (position, key), in the list's order; ids that aren't there drop out."""
    return ids.join(table, key).orderBy(position)


def best_path_match(entries: DataFrame, roots: list[str], tracks: DataFrame) -> DataFrame:
    """Playlist entries (pos, raw) matched to tracks (track_id, path): as written, then below each root in order; the first hit wins."""
    asis = entries.select("pos", "raw", F.lit(0).alias("prio"), F.col("raw").alias("path"))
    below = entries.withColumn("root", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("prio"), F.lit(r).alias("r")) for i, r in enumerate(roots)])))
    tried = below.select("pos", "raw", F.col("root.prio").alias("prio"), F.concat_ws("/", F.rtrim(F.col("root.r"), F.lit("/")), F.regexp_replace("raw", r"^(\./)+", "")).alias("path"))
    hits = asis.unionByName(tried).join(tracks, "path")
    best = first_per_group(hits, ["pos"], ["prio", "track_id"]).select("pos", "track_id")
    return entries.join(best, "pos", "left").select("pos", "raw", "track_id")


def disc_track_or_natural(parts: DataFrame) -> DataFrame:
    """book_id, path, part_index: by disc and track where every part of a book has a track, else by natural path order."""
    from tonearm.functions.names import natural_key

    book = Window.partitionBy("book_id")
    tagged = F.min(F.col("track").isNotNull()).over(book)
    keyed = parts.withColumn("__tagged", tagged).withColumn("__n", natural_key(F.col("path")))
    key = F.when(F.col("__tagged"), F.struct(F.coalesce("disc", F.lit(1)).alias("a"), F.col("track").alias("b"), F.lit("").alias("c"))).otherwise(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("__n").alias("c")))
    return keyed.withColumn("part_index", F.row_number().over(book.orderBy(key, "path")) - 1).drop("__tagged", "__n")


def shuffled(df: DataFrame, seed: int, key: str, current=None) -> DataFrame:
    """Positions of a seeded permutation: the same for the same seed and rows, however they are split over tasks.

    The row whose key is ``current`` comes first, so what is playing goes on.
    """
    from .ordering import numbered

    playing = F.lit(1) if current is None else F.when(F.col(key) == current, 0).otherwise(1)
    return numbered(df.withColumn("__c", playing).withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))), ["__c", "__h", key], "position").drop("__c", "__h")


def picked_at_random(df: DataFrame, seed: int, key: str, n: int) -> DataFrame:
    """The first ``n`` rows of the seeded permutation: each task keeps that many at most."""
    return df.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).orderBy("__h", key).limit(n).drop("__h")


def optional(value, condition: Column) -> Column:
    """A filter that holds for all rows where no value is given (null, empty or 0)."""
    return condition if value else F.lit(True)


def contains_text(c: Column, text: str) -> Column:
    """Contains-search without regard to ASCII case in which ``%`` and ``_`` of the text stand for themselves."""
    return F.contains(ascii_lower(c), F.lit("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text)))


def filtered(df: DataFrame, conditions: list[tuple[object, Column]]) -> DataFrame:
    """All conditions whose value is given, joined by AND: (value, condition) pairs."""
    for value, condition in conditions:
        df = df.where(optional(value, condition))
    return df
