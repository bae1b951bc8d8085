"""Listening sessions folded from position updates: row by row for streams, by windows for batches, with the same results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP_MS = 15 * 60_000
DAY_MS = 86_400_000
SESSIONS = "book_id long, user_id long, seq long, started_at long, ended_at long, start_offset_ms long, end_offset_ms long, open boolean"
STATE = "offset long, seq long, started long, ended long, start_offset long, end_offset long, finished_at long"


@dataclass
class Fold:
    """State of one (book, user): the saved offset, the last session, when it was finished."""

    duration: int
    gap: int = GAP_MS
    offset: int | None = None
    session: list | None = None
    seq: int = 0
    finished_at: int | None = None
    closed: list = field(default_factory=list)

    def update(self, offset: int, now: int) -> None:
        """A gap over the limit or another UTC day ends the last session; an update that doesn't move then opens nothing."""
        offset = min(max(offset, 0), self.duration) if self.duration > 0 else max(offset, 0)
        before, self.offset = self.offset, offset
        s = self.session
        if s is not None and now - s[1] <= self.gap and now // DAY_MS == s[1] // DAY_MS:
            s[1], s[3] = now, offset
        elif before is None or before != offset:
            if s is not None:
                self.closed.append((self.seq - 1, *s))
            self.session, self.seq = [now, now, offset if before is None else before, offset], self.seq + 1
        done = self.duration > 0 and offset >= 0.97 * self.duration
        self.finished_at = (self.finished_at if self.finished_at is not None else now) if done else None


PLACES = "book_id long, user_id long, offset_ms long, updated_at long, finished_at long, sessions long"


def _steps(updates: DataFrame, gap_ms: int) -> DataFrame:
    """Each update with what ``Fold.update`` makes of it, from windows over its (book, user) alone.

    An update counts if it moved, or if it and all before it back to the last move follow each other without a break (a gap over the
    limit or another day): after a break that didn't move, no place goes on.  It begins a session if it moved and doesn't follow one that counts.
    """
    key = Window.partitionBy("book_id", "user_id")
    w = key.orderBy("now_ms", "__raw")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    timed = updates.withColumn("__raw", F.col("offset_ms")).withColumn("__length", F.coalesce(F.max("duration_ms").over(key), F.lit(0)))
    low = F.greatest(F.col("offset_ms"), F.lit(0))
    held = timed.withColumn("offset_ms", F.when(F.col("__length") > 0, F.least(low, "__length")).otherwise(low).cast("long"))
    before, last = F.lag("offset_ms").over(w), F.lag("now_ms").over(w)
    near = (F.col("now_ms") - last <= gap_ms) & (F.floor(F.col("now_ms") / DAY_MS) == F.floor(last / DAY_MS))
    done = (F.col("__length") > 0) & (F.col("offset_ms") >= F.lit(0.97) * F.col("__length"))
    seen = held.select("*", before.alias("__before"), F.coalesce(near, F.lit(False)).alias("__near"), done.alias("__done"), F.row_number().over(w).alias("__n"))
    moved = F.col("__before").isNull() | (F.col("__before") != F.col("offset_ms"))
    marks = seen.withColumn("__moved", moved).withColumn("__move", F.max(F.when(F.col("__moved"), F.col("__n"))).over(upto)).withColumn("__break", F.max(F.when(~F.col("__moved") & ~F.col("__near"), F.col("__n"))).over(upto))
    counted = marks.withColumn("__counts", F.col("__break").isNull() | (F.col("__move") > F.col("__break")))
    follows = F.col("__near") & F.lag("__counts", 1, False).over(w)
    begun = counted.withColumn("__begins", F.col("__moved") & ~follows).withColumn("__finishes", F.col("__done") & ~F.lag("__done", 1, False).over(w))
    return begun.withColumn("__seq", F.sum(F.col("__begins").cast("long")).over(upto))


def fold_places(updates: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """The saved place of each (book, user) after all updates, since when it counts as finished, and how many sessions led there."""
    last = lambda c: F.max_by(c, "__n")
    finished = F.when(last("__done"), F.max(F.when(F.col("__finishes"), F.col("now_ms"))))
    out = _steps(updates, gap_ms).groupBy("book_id", "user_id").agg(last("offset_ms").alias("offset_ms"), F.max("now_ms").alias("updated_at"), finished.alias("finished_at"), F.max("__seq").alias("sessions"))
    return _typed(out, PLACES)


def fold_sessions(updates: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Sessions of updates (book_id, user_id, offset_ms, now_ms, duration_ms), one fold per (book, user) in order of time."""
    steps = _steps(updates, gap_ms).withColumn("__last", F.max("__seq").over(Window.partitionBy("book_id", "user_id")))
    start = F.max(F.when(F.col("__begins"), F.coalesce("__before", "offset_ms")))
    counted = steps.where("__counts").groupBy("book_id", "user_id", "__seq").agg(
        F.min("now_ms").alias("started_at"), F.max("now_ms").alias("ended_at"), start.alias("start_offset_ms"), F.max_by("offset_ms", "__n").alias("end_offset_ms"), (F.col("__seq") == F.max("__last")).alias("open")
    )
    return _typed(counted.withColumn("seq", F.col("__seq") - 1), SESSIONS)


def _typed(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*[F.col(c).cast(kind) for c, kind in (x.split() for x in schema.split(", "))])
