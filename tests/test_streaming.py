import json
import os

from pyspark.sql import functions as F

from tonearm.operators.changelog import ChangeLog
from tonearm.operators.sessions import fold_sessions
from tonearm.streaming import live, notify, producer

MIN = 60_000
DAY = 86_400_000
MOVES = "book_id long, user_id long, offset_ms long, now_ms long, duration_ms long"


def _stream(spark, tmp_path, schema, batches, name="in"):
    d = tmp_path / name
    d.mkdir()
    cols = [c.split()[0] for c in schema.split(", ")]
    for i, rows in enumerate(batches):
        f = d / f"{i:03d}.json"
        f.write_text("\n".join(json.dumps(dict(zip(cols, r))) for r in rows))
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(d)), spark.read.schema(schema).json(str(d))


def test_sessions_end_by_timers_and_state_falls(spark, tmp_path):
    moves = [[(1, 1, 0, 1, 100), (1, 1, 5, 20, 100)], [(1, 1, 5, 40, 100), (2, 1, 3, 41, 100)], [(1, 1, 9, 45, 100), (2, 1, 4, 46, 100)], [(9, 9, 1, 80, 0)], [(9, 9, 2, 300 * 24 * 60, 0)]]
    batches = [[(b, u, x, now * MIN, d) for b, u, x, now, d in part] for part in moves]
    stream, table = _stream(spark, tmp_path, MOVES, batches)
    sessions = live.live_sessions(stream, late="1 second")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    q = sessions.writeStream.foreachBatch(live.to_folders(out)).option("checkpointLocation", state).start()
    q.processAllAvailable()
    kept = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    q.stop()
    got = spark.read.parquet(out)
    columns = ["book_id", "user_id", "seq", "started_at", "ended_at", "start_offset_ms", "end_offset_ms"]
    want = fold_sessions(table).where("NOT open OR ended_at < 200L * 86400000").select(*columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.collect()))
    assert max(kept) == 3 and kept[-1] == 1  # places are forgotten after 90 days of silence


def test_sessions_start_from_saved_places(spark, tmp_path):
    stream, _ = _stream(spark, tmp_path, MOVES, [[(1, 1, 70, MIN, 100), (2, 1, 5, MIN, 100)], [(3, 1, 0, DAY, 0)]])
    saved = spark.createDataFrame([(1, 1, 50), (2, 1, 5)], "book_id long, user_id long, offset_ms long")
    got = live.run_available(live.live_sessions(stream, positions=saved)).where("book_id < 3").collect()
    assert [(r.book_id, r.start_offset_ms, r.end_offset_ms) for r in got] == [(1, 50, 70)]  # the second didn't move


def test_titles_throttle_rates(spark, tmp_path):
    s, _ = _stream(spark, tmp_path, "station string, title string, at long", [[("a", "x", 1), ("a", "x", 2)], [("a", "x", 3), ("a", "y", 4), ("b", None, 1), ("b", None, 2)], [("a", "x", 5)]], "titles")
    got = live.run_available(live.title_history(s))
    assert sorted((r.station, r.title or "", r.at) for r in got.collect()) == [("a", "x", 1), ("a", "x", 5), ("a", "y", 4), ("b", "", 1)]
    s, _ = _stream(spark, tmp_path, "key string, at long", [[("k", 1000), ("k", 1050)], [("k", 1099), ("k", 1100), ("k", 1150)]], "ticks")
    assert sorted(r.at for r in live.run_available(live.throttled(s, 100)).collect()) == [1000, 1100]
    s, _ = _stream(spark, tmp_path, "key string, at long, done long, total long", [[("k", 1000, 0, 100), ("k", 2000, 10, 100)], [("k", 2500, 12, 100), ("k", 3000, 30, 100)]], "rates")
    got = {r.at: (r.rate, r.eta_s) for r in live.run_available(live.rates(s)).collect()}
    assert got == {1000: (None, None), 2000: (10.0, 9.0), 2500: (10.0, 8.8), 3000: (13.0, 70 / 13.0)}


def test_latest_positions_and_windows(spark, tmp_path):
    s, _ = _stream(spark, tmp_path, "book_id long, user_id long, offset_ms long, now_ms long", [[(1, 1, 5, 1)], [(1, 1, 7, 2), (2, 1, 1, 1)]])
    assert sorted(map(tuple, live.run_available(live.latest_positions(s), "complete").collect())) == [(1, 1, 7, 2), (2, 1, 1, 1)]
    timed = s.withColumn("ts", F.timestamp_seconds("now_ms"))
    got = live.run_available(live.windowed_counts(timed, "ts", "0 seconds", "2 seconds", None, ["user_id"]), "complete")
    assert sorted(r.n for r in got.collect()) == [1, 2]


def test_the_producer_is_bounded_and_resumes(spark, tmp_path):
    rows = spark.range(100).select("id", F.timestamp_seconds("id").alias("at"), F.when(F.col("id") % 3 > 0, "x").alias("s"))
    path = producer.staged(rows, ["id"], 10)
    stream = producer.produced(spark, path, rows.schema, per_trigger=3)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    sizes = []

    def sink(batch, number):
        live.to_folders(out)(batch, number)
        sizes.append(batch.count())
        if len(sizes) == 2:
            raise RuntimeError("cancelled")

    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", state).start()
    try:
        q.processAllAvailable()
    except Exception:
        pass
    q.stop()
    assert len(sizes) == 2 and max(sizes) < 60  # three of ten chunks a trigger
    got = live.run_available(stream, "append", state, out)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(map(tuple, rows.collect()), key=lambda r: r[0])


def test_a_repeated_batch_makes_no_second_marker(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    log, markers = ChangeLog.created(rows, "id", ["t"]), str(tmp_path / "markers")
    sink = notify.notifying(log, markers)
    batch = spark.createDataFrame([(2, "B"), (3, "c")], "id long, t string")
    sink(batch, 0)
    sink(batch, 0)  # as after a failure before the batch was noted as done
    assert log.revision() == 2 and sorted(map(tuple, notify.notified(log, markers).collect())) == [(2, 2, 0)]
    log.record(spark.createDataFrame([(1, "z")], "id long, t string"))  # recorded, but its marker was not written
    sink(spark.createDataFrame([(1, "z")], "id long, t string"), 1)
    assert sorted(r.rev for r in notify.notified(log, markers).collect()) == [2, 3]
