"""Order-dependent shapes: running sums, change detection, keep-newest, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .carried import carried_forward, carried_sum, held_peak, moving_average


def start_offsets(parts: DataFrame, book: str, order: list, duration: str, out: str = "start_offset_ms") -> DataFrame:
    """Sum of what comes before, 0 for the first."""
    return carried_sum(parts, book, order, F.col(duration), out)


def chapter_durations(chapters: DataFrame, part: str, start: str, part_end: str, order: list, out: str = "duration_ms") -> DataFrame:
    """To the next start, the last one to the part's end, never negative. ``order``: column names, ascending."""
    nxt = carried_forward(chapters, part, [F.desc(c) for c in order], F.struct(F.col(start).alias("s")), "__next", own=False)
    return nxt.withColumn(out, F.greatest(F.lit(0), F.coalesce("__next.s", F.col(part_end)) - F.col(start))).drop("__next")


def changed_rows(df: DataFrame, key: str, order: list, value: str) -> DataFrame:
    """Rows whose value differs from the row before in the group (nulls are equal)."""
    before = carried_forward(df, key, order, F.struct(F.col(value).alias("v")), "__b", own=False)
    return before.where(F.col("__b").isNull() | ~F.col("__b.v").eqNullSafe(F.col(value))).drop("__b")


def dense_positions(df: DataFrame, group: str, order: list, out: str = "position", base: int = 0) -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1 + base)


def latest_per_group(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def excess_beyond_newest(df: DataFrame, group: str, keep: Column, delete_order: list) -> DataFrame:
    """Rows to delete so that ``keep`` (1 at least) stay, in delete order."""
    w = Window.partitionBy(group)
    n, r = F.count("*").over(w), F.row_number().over(w.orderBy(*delete_order))
    return df.withColumn("__n", n).withColumn("__r", r).where(F.col("__r") <= F.col("__n") - F.greatest(keep, F.lit(1))).drop("__n", "__r")


def sliding_minimum(df: DataFrame, stream: str, order: str, value: str, ahead: int, out: str = "target") -> DataFrame:
    """The least value from a row to ``ahead`` rows on."""
    return df.withColumn(out, F.min(value).over(Window.partitionBy(stream).orderBy(order).rowsBetween(0, ahead)))


def ewma(df: DataFrame, key: str, order: str, value: str, weight: float = 0.3, out: str = "rate") -> DataFrame:
    """Moving average in which a new value counts ``weight``; the first one starts it."""
    return moving_average(df, key, [order], value, weight, out)


def peak_hold(df: DataFrame, key: str, order: str, value: str, decay: float, out: str = "peak") -> DataFrame:
    """The greater of each new value and the decayed peak."""
    return held_peak(df, key, [order], value, decay, out)


def hysteresis(df: DataFrame, key: str, order: list, value: str, on: float, off: float, out: str = "matched") -> DataFrame:
    """True from a value at or below ``on`` until one above ``off`` or a null."""
    v = F.col(value)
    decisive = F.when(v.isNull(), F.lit(False)).when(v <= on, F.lit(True)).when(v > off, F.lit(False))
    return carried_forward(df, key, order, decisive, "__m").withColumn(out, F.coalesce("__m", F.lit(False))).drop("__m")


def listened_by_day(sessions: DataFrame, zone: str = "UTC") -> DataFrame:
    """Per day of a time zone: ms listened and where the last session stopped. ``sessions``: id, started_at, ended_at, start_offset_ms, end_offset_ms."""
    day = F.to_date(F.from_utc_timestamp(F.timestamp_millis("started_at"), zone))
    ms = F.greatest(F.lit(0), F.col("end_offset_ms") - F.col("start_offset_ms"))
    return sessions.groupBy(day.alias("day")).agg(F.sum(ms).alias("listened_ms"), F.max_by("end_offset_ms", F.struct("ended_at", "id")).alias("stopped_at_ms"))


def within_budget(files: DataFrame, budget: int, keep: str | None = None) -> DataFrame:
    """Cached files that stay under a byte budget, most recently used first; ``keep`` is never evicted. ``files``: name, size, used_at."""
    from .ordering import running_total

    first = (F.col("name") == keep) if keep is not None else F.lit(False)
    summed = running_total(files.withColumn("__first", first), [F.desc("__first"), F.desc("used_at"), "name"], F.col("size").cast("long"), "__s")
    return summed.where((F.col("__s") <= budget) | F.col("__first")).drop("__s", "__first")
