"""Playlist text: M3U in; M3U, PLS and XSPF out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions.text import percent_encode, xml_escape


def m3u_entries(files: DataFrame) -> DataFrame:
    """(name, pos, raw, title) of playlist texts (name, text): the last ``#EXTINF`` title before an entry, and since the entry before."""
    lines = files.select("name", F.posexplode(F.split("text", r"\r?\n|\r")).alias("line", "s")).withColumn("s", F.trim("s"))
    info = r"^#EXTINF:[^,]*,(.*)$"
    title = F.when(F.col("s").startswith("#EXTINF:"), F.trim(F.regexp_extract("s", info, 1)))
    entry = (F.col("s") != "") & ~F.col("s").startswith("#")
    w = Window.partitionBy("name").orderBy("line")
    marked = lines.withColumn("t", title).withColumn("e", entry).withColumn("n", F.coalesce(F.sum(F.col("e").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy("name", "n").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    named = marked.withColumn("title", F.last("t", ignorenulls=True).over(own)).where("e")
    return named.select("name", F.col("n").cast("long").alias("pos"), F.col("s").alias("raw"), F.nullif("title", F.lit("")).alias("title"))


def one_line(c):
    """Control characters become spaces: a line break would split an entry."""
    return F.trim(F.regexp_replace(c.cast("string"), r"\p{Cc}", " "))


def export_entries(entries: DataFrame) -> DataFrame:
    """Entries ready to be written: name, pos, path, title, artist, album, duration_ms, image.

    Tags are single lines, blank ones are null; an entry without a title has its file's name without the ending.
    ``entries`` may lack artist, album, duration_ms and image.
    """
    has = lambda c: F.col(c) if c in entries.columns else F.lit(None)
    tag = lambda c: F.nullif(one_line(has(c)), F.lit(""))
    file = F.element_at(F.split("path", "/"), -1)
    stem = one_line(F.regexp_replace(file, r"(?s)^(.+)\.[^.]*$", "$1"))
    return entries.select("name", "pos", "path", F.coalesce(tag("title"), stem).alias("title"), tag("artist").alias("artist"), tag("album").alias("album"), has("duration_ms").cast("long").alias("duration_ms"), has("image").cast("string").alias("image"))


def whole_seconds(ms):
    """Rounded, 1 at least; -1 where unknown. Never 0: players take that for an empty entry."""
    return F.when(ms > 0, F.greatest(F.floor((ms + 500) / 1000), F.lit(1))).otherwise(F.lit(-1)).cast("string")


def _written(entries: DataFrame, line, head, tail) -> DataFrame:
    """A text for each playlist; it is gathered in one row, as it is one file."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"])
    return entries.groupBy("name").agg(F.concat(head, F.array_join(lines, ""), tail).alias("text"))


def to_m3u(entries: DataFrame) -> DataFrame:
    """(name, text) in the extended M3U form; ``entries`` as ``export_entries`` takes them."""
    label = F.concat_ws(" - ", "artist", "title")
    line = F.concat(F.lit("#EXTINF:"), whole_seconds(F.col("duration_ms")), F.lit(","), label, F.lit("\n"), F.col("path"), F.lit("\n"))
    return _written(export_entries(entries), line, F.lit("#EXTM3U\n"), F.lit(""))


def to_pls(entries: DataFrame) -> DataFrame:
    """(name, text) in the PLS form, numbered from 1 in order of ``pos``."""
    rows = export_entries(entries).withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("pos")).cast("string"))
    pairs = [("File", F.col("path")), ("Title", F.concat_ws(" - ", "artist", "title")), ("Length", whole_seconds(F.col("duration_ms")))]
    line = F.concat(*[c for key, value in pairs for c in (F.lit(key), F.col("n"), F.lit("="), value, F.lit("\n"))])
    return _written(rows, line, F.lit("[playlist]\n"), F.concat(F.lit("NumberOfEntries="), F.count(F.lit(1)).cast("string"), F.lit("\nVersion=2\n")))


def to_xspf(entries: DataFrame) -> DataFrame:
    """(name, text) in the XSPF form with the playlist's name as its title; a path becomes a file address."""

    def tag(name, c, when=None):
        text = F.concat(F.lit(f"      <{name}>"), xml_escape(c.cast("string")), F.lit(f"</{name}>\n"))
        return F.when(c.isNotNull() if when is None else when, text).otherwise("")

    address = F.concat(F.lit("file://"), F.array_join(F.transform(F.split("path", "/"), lambda x: percent_encode(x)), "/"))
    ms = F.col("duration_ms")
    tags = [tag("location", address), tag("title", F.col("title")), tag("creator", F.col("artist")), tag("album", F.col("album")), tag("duration", ms, ms > 0), tag("image", F.col("image"))]
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<playlist version="1" xmlns="http://xspf.org/ns/0/">\n  <title>'), xml_escape(F.col("name").cast("string")), F.lit("</title>\n  <trackList>\n"))
    return _written(export_entries(entries), F.concat(F.lit("    <track>\n"), *tags, F.lit("    </track>\n")), head, F.lit("  </trackList>\n</playlist>\n"))


def exported(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(playable entries, skipped count per playlist): missing and undecodable tracks stay out. ``entries`` also has missing, decodable."""
    ok = ~F.col("missing") & F.col("decodable")
    return entries.where(ok), entries.groupBy("name").agg(F.count_if(~ok).alias("skipped"))
