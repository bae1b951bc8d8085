"""Matching by edit distance over whole tables: an index of text segments instead of all pairs.

Two texts of similarity s = 1 - distance / longer length, of which the index holds one of length l, differ by at most k edits, where k follows
from s and l.  Cut that text into k + 1 segments: k edits leave one of them whole, shifted by at most k places, in the
other text.  So indexed texts are stored under (length, segment number, segment), a probe looks up its own pieces
for every length and number that may fit, and only texts that meet are compared.  Texts too short for k + 1 segments meet by
length.  Equal texts are compared once, whatever number of rows hold them.

Unlike texts meet by chance, the less often the longer a segment is (three letters: a few pairs in a thousand); tables in
which most texts share a segment at one place (one long common beginning) should be matched on the part that differs.  Null texts match nothing; empty texts match empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.functions import names

from .ordering import cut

LEVELS = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)
_SLACK = 1e-6  # similarities are floats


def _edits(length, least: float):
    """The most edits between a text of this length and any other at the similarity."""
    return F.floor(F.floor(length / least + _SLACK) * (1 - least) + _SLACK).cast("int")


def similar(probes: DataFrame, indexed: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of all distinct texts a of ``probes`` and b of ``indexed`` (column ``text``) that are ``least`` alike or more."""
    if not 0 < least <= 1:
        raise ValueError("a similarity above 0 and at most 1")
    size = F.char_length("text")
    side = lambda d: d.select("text").where("text IS NOT NULL").distinct()
    stored = side(indexed).select(F.col("text").alias("b"), size.alias("l")).withColumn("k", _edits(F.col("l"), least))
    # a place (l, i) has its segment from floor(i l / (k + 1)) to floor((i + 1) l / (k + 1))
    start = F.floor(F.col("i") * F.col("l") / (F.col("k") + 1)).cast("int")
    many = (F.floor((F.col("i") + 1) * F.col("l") / (F.col("k") + 1)) - start).cast("int")
    whole = F.col("k") + 1 <= F.col("l")
    last = F.when(whole, F.col("k")).otherwise(0)
    kept = stored.withColumn("i", F.explode(F.sequence(F.lit(0), last))).select("b", "l", "i", F.when(whole, F.substring("b", start + 1, many)).otherwise("").alias("piece"))
    asked = side(probes).select(F.col("text").alias("a"), size.alias("m"))
    asked = asked.withColumn("l", F.explode(F.sequence(F.ceil(F.col("m") * least - _SLACK).cast("int"), F.floor(F.col("m") / least + _SLACK).cast("int")))).withColumn("k", _edits(F.col("l"), least))
    asked = asked.withColumn("i", F.explode(F.sequence(F.lit(0), last))).withColumn("from", F.when(whole, start).otherwise(0)).withColumn("many", F.when(whole, many).otherwise(0))
    low, high = F.greatest(F.lit(0), F.col("from") - F.col("k")), F.least(F.col("m") - F.col("many"), F.col("from") + F.col("k"))
    at = F.when(whole, F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))).otherwise(F.array(F.lit(0)))
    asked = asked.withColumn("p", F.explode(at)).select("a", "l", "i", F.when(F.col("many") > 0, F.substring("a", F.col("p") + 1, F.col("many"))).otherwise("").alias("piece")).distinct()
    met = asked.join(kept, ["l", "i", "piece"]).select("a", "b", names.similarity(F.col("a"), F.col("b")).alias("similarity"))
    return met.where(F.col("similarity") >= F.lit(least).cast("float")).distinct()


def nearest(probes: DataFrame, indexed: DataFrame, least: float, apart: bool = False) -> DataFrame:
    """(a, b, similarity): for each text of ``probes`` all texts of ``indexed`` of its greatest similarity, if that is ``least`` or more.

    Close texts are looked for first; only texts without any go on to a lower level.  ``apart``: a text isn't its own match.
    """
    left, found = cut(probes.select("text").where("text IS NOT NULL").distinct()), None
    for level in [x for x in LEVELS if x > least] + [least]:
        pairs = similar(left, indexed, level)
        pairs = pairs.where("a <> b") if apart else pairs
        best = Window.partitionBy("a")
        here = cut(pairs.withColumn("best", F.max("similarity").over(best)).where("similarity = best").drop("best"))
        found = here if found is None else found.unionByName(here)
        left = cut(left.join(here.select(F.col("a").alias("text")), "text", "left_anti"))
        if left.isEmpty():
            break
    return found


def other_row_matches(rows: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """(a, b, similarity): each row's best match among all other rows; of equal ones that of the greatest key.

    Rows of one text are grouped: a row's match is another of its group, or the greatest key of a nearest group.
    """
    first = rows.select(F.col(text).alias("text"), F.col(key).alias("first")).where("text IS NOT NULL")
    # at most two keys of a text are kept: the greatest, and the one that its own row takes
    greatest = first.groupBy("text").agg(F.max("first").alias("g"))
    second = first.join(greatest, "text").where("first <> g").groupBy("text").agg(F.max("first").alias("s"))
    groups = cut(greatest.join(second, "text", "left"))
    lone = groups.where("s IS NULL").select("text", "g")
    near = nearest(lone, groups, least, apart=True).join(groups.select(F.col("text").alias("b"), "g"), "b").groupBy("a").agg(F.max("g").alias("other"), F.max("similarity").alias("similarity"))
    named = groups.join(near.withColumnRenamed("a", "text"), "text", "left")
    match = F.when(F.col("s").isNull(), F.col("other")).when(F.col("first") == F.col("g"), F.col("s")).otherwise(F.col("g"))
    sure = F.when(F.col("s").isNull(), F.col("similarity")).otherwise(F.lit(1.0).cast("float"))
    return first.join(named, "text").select(F.col("first").alias("a"), match.alias("b"), sure.alias("similarity")).where("b IS NOT NULL")
