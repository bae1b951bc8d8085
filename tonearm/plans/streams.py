"""Queries that run a given table through a stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tonearm.operators import changelog
from tonearm.operators.ordering import shared_folder
from tonearm.plans.registry import query
from tonearm.streaming import live, notify, producer

GAP = 6 * 3_600_000


def _stream(table, order, chunks, per_trigger=1):
    return producer.produced(table.sparkSession, producer.staged(table, order, chunks), table.schema, per_trigger)


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, lag(epoch_us(ts) // 1000) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(CASE WHEN before IS NULL OR ms - before > 21600000 OR ms // 86400000 <> before // 86400000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id) - 1 AS seq FROM e),
s AS (SELECT user_id, CAST(seq AS BIGINT) AS seq, min(ms) AS started_at, max(ms) AS ended_at FROM b GROUP BY 1, 2)
SELECT * FROM s WHERE EXISTS (SELECT 1 FROM s n WHERE n.user_id = s.user_id AND n.seq > s.seq) OR ended_at + 21600001 <= (SELECT max(epoch_us(ts) // 1000) - 10000 FROM events)""")
def sessions_streamed(t):
    """Sessions of events that arrive in order of time: those that have ended, by another or by a timer."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    moves = t.events.select(F.lit(1).cast("long").alias("book_id"), "user_id", F.row_number().over(w).cast("long").alias("offset_ms"), F.unix_millis("ts").alias("now_ms"), F.lit(0).cast("long").alias("duration_ms"))
    return live.run_available(live.live_sessions(_stream(moves, ["now_ms"], 4), GAP)).select("user_id", "seq", "started_at", "ended_at")


@query("SELECT user_id AS station, event_type AS title, epoch_us(ts) // 1000 AS at FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_type) AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def titles_streamed(t):
    """Titles that differ from the station's last one, as they come."""
    titles = t.events.select(F.col("user_id").cast("string").alias("station"), F.col("event_type").alias("title"), F.unix_millis("ts").alias("at"))
    return live.run_available(live.title_history(_stream(titles, ["at", "title"], 3))).withColumn("station", F.col("station").cast("long"))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000) AS r FROM events),
f AS (SELECT user_id, ms, r, ms AS last FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.ms, e.r, CASE WHEN e.ms - f.last >= 7200000 THEN e.ms ELSE f.last END FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
SELECT CAST(user_id AS VARCHAR) AS key, last AS at FROM f GROUP BY 1, 2""")
def throttle_streamed(t):
    """At most one event of a user in two hours, the first at once."""
    rows = t.events.select(F.col("user_id").cast("string").alias("key"), F.unix_millis("ts").alias("at"))
    return live.run_available(live.throttled(_stream(rows, ["at"], 3), 7_200_000))


@query("SELECT user_id, count(*) AS n, max_by(event_id, (ts, event_id)) AS last FROM events GROUP BY 1")
def latest_state_streamed(t):
    """The newest event of each user, and how many there were, from an aggregation that is updated with every trigger."""
    rows = t.events.select("user_id", "event_id", F.unix_micros("ts").alias("at"))
    state = _stream(rows, ["at"], 3).groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("at", "event_id")).alias("last"))
    return live.run_available(state, "complete")


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def orders_produced(t):
    """All orders through the bounded producer: cancelled after a trigger, resumed to the end."""
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    stream = _stream(rows, ["o_orderkey"], 6, 2)
    out, state = shared_folder(t.spark, "stream"), shared_folder(t.spark, "stream-state")
    q = stream.writeStream.foreachBatch(live.to_folders(out)).option("checkpointLocation", state).trigger(once=True).start()
    q.awaitTermination()
    return live.run_available(stream, "append", state, out)


@query("SELECT 2 + o_orderkey % 4 AS rev, count(*) AS changed, CAST(0 AS BIGINT) AS removed FROM orders GROUP BY 1")
def catalogue_notified(t):
    """A marker for each revision that batches of orders make in a change log."""
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    log, markers = changelog.ChangeLog.created(rows.limit(0), "o_orderkey", ["o_orderstatus"]), shared_folder(t.spark, "markers")
    stream = producer.produced(t.spark, producer.staged(rows, chunks=4, number=F.col("o_orderkey") % 4), rows.schema)
    q = stream.writeStream.foreachBatch(notify.notifying(log, markers)).option("checkpointLocation", shared_folder(t.spark, "stream-state")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return notify.notified(log, markers).select("rev", "changed", "removed")
