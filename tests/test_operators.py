import numpy as np
from pyspark.sql import functions as F

from tonearm.operators import analytic, changes, entities, relational, sessions, signal, textindex

MIN = 60_000


def test_pages(spark):
    df = spark.range(10)
    assert [r.id for r in relational.page(df, ["id"], 2, 3).collect()] == [3, 4, 5]
    assert relational.page(df, ["id"], 1, -1).count() == 10 and relational.page(df, ["id"], 1, 0).count() == 1
    assert [r.id for r in relational.page_after(df, "id", 6, 5).collect()] == [7, 8, 9]
    a, b = relational.shuffled(df, 5, "id"), relational.shuffled(df.repartition(3), 5, "id")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_offsets(spark):
    parts = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 5), (1, 2, 15, 5)], "book_id long, part_index int, start_offset_ms long, duration_ms long")
    xs = spark.createDataFrame([(1, x) for x in (-5, 0, 9, 10, 19, 20, 99)], "book_id long, x long")
    got = {r.x: (r.part_index, r.within_ms) for r in relational.resolve_offset(xs, parts).collect()}
    assert got == {-5: (0, 0), 0: (0, 0), 9: (0, 9), 10: (1, 0), 19: (2, 4), 20: (2, 5), 99: (2, 5)}
    spans = spark.createDataFrame([(1, 0, 1), (1, 10, 2), (1, 10, 3)], "k long, s long, id long")
    points = spark.createDataFrame([(1, -1), (1, 5), (1, 10), (2, 5)], "k long, t long")
    got = {(r.k, r.t): r.found_id for r in relational.starting_at_or_before(points, spans, "k", "t", "s", "id", ["id"]).collect()}
    assert got == {(1, -1): None, (1, 5): 1, (1, 10): 3, (2, 5): None}


def test_part_order(spark):
    rows = [(1, "b/10.mp3", None, None), (1, "b/2.mp3", None, 7), (2, "x", 2, 1), (2, "y", None, 2), (2, "z", 1, 1)]
    got = {(r.book_id, r.path): r.part_index for r in relational.disc_track_or_natural(spark.createDataFrame(rows, "book_id long, path string, disc int, track int")).collect()}
    assert got == {(1, "b/2.mp3"): 0, (1, "b/10.mp3"): 1, (2, "z"): 0, (2, "y"): 1, (2, "x"): 2}


def test_duplicates_ignore_null_keys(spark):
    rows = [(1, 1, "h", False), (2, 1, "h", False), (3, 1, "h", True), (4, None, "h", False), (5, None, "h", False), (6, 1, None, False), (7, 1, None, False)]
    t = spark.createDataFrame(rows, "id long, album long, hash string, missing boolean")
    got = {r.id: r.duplicate_of for r in entities.duplicate_keepers(t, ["album", "hash"], "id", ~F.col("missing")).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: None, 5: None, 6: None, 7: None}


def test_book_duplicates(spark):
    parts = [(b, i, f"h{i}") for b in (1, 2, 3) for i in range(3)] + [(4, 0, "h0"), (4, 1, None), (5, 0, "h0"), (5, 1, None)]
    books = spark.createDataFrame([(1, None), (2, 5), (3, 9), (4, 1), (5, 1)], "book_id long, last_played long")
    got = entities.book_duplicates(spark.createDataFrame(parts, "book_id long, part_index int, hash string"), books)
    assert {(r.book_id, r.duplicate_of) for r in got.collect()} == {(1, 3), (2, 3)}


def test_consolidation_and_merge(spark):
    albums = spark.createDataFrame([(1, "t", "a"), (2, "t", "b"), (3, "t", "b"), (4, "t", "c"), (5, "t", "a")], "id long, title_key string, artist_key string")
    tracks = spark.createDataFrame([(1, "f1"), (2, "f1"), (3, "f2"), (4, "f9")], "album_id long, folder string")
    got = {r.album_id: r.survivor for r in entities.consolidated(albums, tracks).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
    full = spark.createDataFrame([(1, None, "A"), (2, 1999, "B"), (3, 2000, "B"), (4, None, "C")], "id long, year int, artist string")
    merged = {r.id: (r.year, r.artist) for r in entities.merged_fields(full, entities.consolidated(albums, tracks), ["year"]).collect()}
    assert merged == {1: (1999, "Various Artists"), 4: (None, "C")}


def test_album_resolution(spark):
    albums = spark.createDataFrame([(1, "t", "x", "f0"), (2, "t", "y", "f1"), (3, "t", "various artists", "f3")], "id long, title_key string, artist_key string, folder string")
    files = spark.createDataFrame([("p1", "f9", "t", "y", "z"), ("p2", "f1", "t", None, "x"), ("p3", "f9", "t", None, "x"), ("p4", "f9", "t", None, "q"), ("p5", "f9", "u", None, "x")], "path string, folder string, title_key string, album_artist_key string, artist_key string")
    got = {r.path: (r.album_id, r.rule) for r in entities.resolved_album(files, albums).collect()}
    assert got == {"p1": (2, "album_artist"), "p2": (2, "folder"), "p3": (1, "artist"), "p4": (3, "various"), "p5": (None, "new")}


def test_genres(spark):
    raws = ["Pop, Rock", "Pinoy Rock", "Unknown genre", "Trip_Hop", "12", "rock;Rock"]
    tracks = spark.createDataFrame([(i, r, i == 5, None) for i, r in enumerate(raws)] + [(9, None, False, None), (8, "Pop, Rock", False, 0)], "id long, raw string, missing boolean, duplicate_of long")
    alias = spark.createDataFrame([("pop", "Pop"), ("rock", "Rock")], "key string, genre string")
    words = spark.createDataFrame([("rock", "Rock"), ("pinoyrock", "Rock")], "word string, genre string")
    mapped = entities.genre_map(tracks.where("raw IS NOT NULL"), alias, words)
    got = {(r.raw, r.genre, r.how) for r in mapped.collect()}
    assert got == {("Pop, Rock", "Pop", "alias"), ("Pop, Rock", "Rock", "alias"), ("Pinoy Rock", "Rock", "keyword"), ("Unknown genre", "Unknown genre", "unmapped"), ("Trip_Hop", "Trip Hop", "unmapped"), ("rock;Rock", "Rock", "alias")}
    assert [(r.raw, r["count"], r.genres) for r in entities.genre_report(tracks, mapped, "keyword").collect()] == [("Pinoy Rock", 1, ["Rock"])]
    assert [(r.raw, r["count"], r.genres) for r in entities.genre_report(tracks, mapped, "ignored").collect()] == [("12", 1, [])]
    assert {(r.id, r.genre) for r in entities.track_genres(tracks, mapped).collect()} == {(0, "Pop"), (0, "Rock"), (1, "Rock"), (2, "Unknown genre"), (3, "Trip Hop")}


def test_search_cuts_before_it_filters(spark):
    docs = spark.createDataFrame([(i, "jazz " * (10 - i) + "x", i % 2 == 0) for i in range(10)] + [(99, "jazzy-night blue", True)], "id long, t string, ok boolean")
    index = textindex.built(docs, "id", "t")
    assert [r.id for r in entities.search(index, docs, "JAZZ", "id", F.col("ok"), most=3).orderBy(F.desc("rank")).collect()] == [0, 2]
    assert [r.id for r in entities.search(index, docs, 'blu "jazzy-', "id").collect()] == [99]
    try:
        entities.search(index, docs, ' "" ', "id")
        raise AssertionError
    except ValueError:
        pass


def test_fuzzy_matches(spark):
    rows = [(1, 0, "Kind of Blue", "Miles Davis", 5, 100), (1, 1, "Kind of Blue", "Miles Davis", 5, 100), (1, 2, "Kind of Bleu", None, 9, 90)]
    c = spark.createDataFrame(rows, "q long, pos int, t string, a string, n int, s int")
    conf = entities.release_confidence(F.lit("kind of  blue"), F.lit("MILES DAVIS"), F.lit(5), F.col("t"), F.col("a"), F.col("n"), F.col("s"))
    best = entities.best_match(c, "q", conf, "pos", 0.8).first()
    assert best.pos == 1 and abs(best.confidence - 1.0) < 1e-6
    b = spark.createDataFrame([("Dune", ["Herbert, Frank"]), ("Dune: x", None)], "t string, a array<string>")
    got = [round(r.o, 3) for r in b.select(entities.book_confidence(F.lit("Dune: Deluxe"), F.lit("Frank Herbert"), F.col("t"), F.col("a")).alias("o")).collect()]
    assert got[1] == 0.9 and 0.6 < got[0] < 1


def test_playlists_and_queues(spark):
    tracks = spark.createDataFrame([(1, "/a/x.mp3"), (2, "/b/y.mp3"), (3, "/a/y.mp3")], "track_id long, path string")
    entries = spark.createDataFrame([(0, "/a/x.mp3"), (1, "y.mp3"), (2, "nope.mp3")], "pos long, raw string")
    matched, missed = entities.playlist_import(entries, ["/b/", "/a"], tracks)
    assert [tuple(r) for r in matched.orderBy("position").collect()] == [(0, 1), (1, 2)] and missed.first().raw == "nope.mp3"
    pl = spark.createDataFrame([(1, 0, 10), (1, 1, 11)], "playlist_id long, position int, track_id long")
    more = spark.createDataFrame([(1, 0, 12), (2, 0, 13)], "playlist_id long, ord int, track_id long")
    assert sorted(map(tuple, entities.appended(pl, more).collect())) == [(1, 0, 10), (1, 1, 11), (1, 2, 12), (2, 0, 13)]
    q = spark.createDataFrame([(1, i, 100 + i) for i in range(4)], "queue_id long, position int, track_id long")
    order = lambda d: [r.track_id for r in d.orderBy("position").collect()]
    assert order(entities.queue_moved(q, 0, 2)) == [101, 102, 100, 103] and order(entities.queue_moved(q, 3, 1)) == [100, 103, 101, 102]
    assert order(entities.queue_removed(q, 1)) == [100, 102, 103]
    ins = spark.createDataFrame([(1, 0, 7), (1, 1, 8)], "queue_id long, ord int, track_id long")
    assert order(entities.queue_inserted(q, ins, 2)) == [100, 101, 7, 8, 102, 103]


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 1), (3, None, 1)], "id long, v string, dismissed int")
    new = spark.createDataFrame([(2, "b", 0), (3, "c", 0), (4, "d", 0)], "id long, v string, dismissed int")
    keep = lambda c, a, b: F.when(F.col("__o_v") == F.col("__n_v"), a).otherwise(b) if c == "dismissed" else b
    assert sorted(map(tuple, changes.upserted(old, new, ["id"], keep).collect())) == [(1, "a", 0), (2, "b", 1), (3, "c", 0), (4, "d", 0)]
    changed, gone = changes.change_feed(old, new, "id", ["v"], 7)
    assert sorted((r.id, r.rev) for r in changed.collect()) == [(3, 7), (4, 7)] and [tuple(r) for r in gone.collect()] == [(1, 7)]
    applied = changes.delta_applied(old, changed.withColumn("missing", F.col("id") == 4), gone, "id")
    assert sorted(r.id for r in applied.collect()) == [2, 3]
    assert changes.delta_kind("c", 9, "c", 9, 0, 5) == "none" and changes.delta_kind("c", 9, "x", 9, 0, 5) == "full"
    assert changes.delta_kind("c", 9, None, 3, 2, 10) == "rows" and changes.delta_kind("c", 9, "c", 3, 3, 10) == "full" and changes.delta_kind("c", 9, "c", 10, 0, 1) == "full"
    assert changes.dropped_from_feed(old, new.limit(0), ["id"]).count() == 0 and changes.dropped_from_feed(old, new, ["id"]).count() == 1
    files = spark.createDataFrame([("a", 1, 1), ("b", 2, None), ("d", 1, 1)], "path string, size long, mtime long")
    known = spark.createDataFrame([("a", 1, 2), ("b", 2, None), ("c", 1, 1)], "path string, size long, mtime long")
    assert {r.path: r.action for r in changes.scan_plan(known, files).collect()} == {"a": "update", "b": "skip", "c": "missing", "d": "add"}
    p = spark.createDataFrame([(1, 5), (2, None), (3, None)], "id long, played_at long")
    assert sorted(map(tuple, changes.played_marked(p, spark.createDataFrame([(1,), (2,)], "id long"), "id", True, 9).collect()), key=str) == [(1, 5), (2, 9), (3, None)]
    names_ = changes.got_or_created(spark.createDataFrame([(1, "x")], "id long, name string"), spark.createDataFrame([("x",), ("z",), ("y",), ("y",)], "name string"), 2)
    assert sorted(map(tuple, names_.collect())) == [(1, "x"), (2, "y"), (3, "z")]
    jobs = changes.jobs_after_restart(spark.createDataFrame([("queued",), ("done",)], "status string"))
    assert [r.status for r in jobs.collect()] == ["failed", "done"]


def test_keep_newest(spark):
    rows = [(1, 1, None, 10), (1, 2, 5, 30), (1, 3, None, None), (1, 4, 5, 20)]
    t = spark.createDataFrame(rows, "feed long, id long, played long, pub long")
    got = analytic.excess_beyond_newest(t, "feed", F.lit(0), [F.col("played").isNull(), F.coalesce("pub", F.lit(0)), "id"])
    assert sorted(r.id for r in got.collect()) == [2, 3, 4]


def _fold(spark, updates, duration=1000):
    rows = [(1, 1, o, n, duration) for o, n in updates]
    df = sessions.fold_sessions(spark.createDataFrame(rows, "book_id long, user_id long, offset_ms long, now_ms long, duration_ms long"))
    return [(r.started_at, r.ended_at, r.start_offset_ms, r.end_offset_ms) for r in df.orderBy("seq").collect()]


def test_sessions(spark):
    assert _fold(spark, [(0, 0), (10, 15 * MIN)]) == [(0, 15 * MIN, 0, 10)]
    assert _fold(spark, [(0, 0), (10, 15 * MIN + 1)]) == [(0, 0, 0, 0), (15 * MIN + 1, 15 * MIN + 1, 0, 10)]
    assert _fold(spark, [(5, 0), (5, 20 * MIN), (9, 25 * MIN)]) == [(0, 0, 5, 5), (25 * MIN, 25 * MIN, 5, 9)]
    day = 86_400_000
    assert _fold(spark, [(1, day - 1000), (2, day + 1000)]) == [(day - 1000, day - 1000, 1, 1), (day + 1000, day + 1000, 1, 2)]
    assert _fold(spark, [(5000, 0), (-3, 1)]) == [(0, 1, 1000, 0)]
    f = sessions.Fold(100)
    for offset, now in ((97, 1), (98, 2), (50, 3)):
        f.update(offset, now)
    assert f.finished_at is None


def test_signal(spark):
    rate = 8000
    tone = (np.sin(2 * np.pi * 1000 * np.arange(rate * 2) / rate) * 0.5)[:, None]
    e = signal.block_energies(tone, rate)
    assert np.allclose(e[:-4], 0.125, atol=1e-3) and len(e) == 17
    assert len(signal.block_energies(tone[:10], rate)) == 1
    rows = [(1, float(x)) for x in signal.block_energies(np.concatenate([tone, np.zeros((rate * 4, 1))]), rate)] + [(2, 0.0)]
    got = {r.s: r.lufs for r in signal.gated_loudness(spark.createDataFrame(rows, "s long, e double"), "s", "e").collect()}
    assert abs(got[1] - (-0.691 + 10 * np.log10(0.125))) < 0.7 and got[2] is None
    flat = signal.equalised(tone, rate, [signal.Band("peaking", 1000, 6.0, 1.0)])
    assert abs(np.abs(flat[rate:]).max() / 0.5 - 10 ** (6 / 20)) < 0.02
    for kind, f, want in (("low_shelf", 5.0, 6.0), ("low_shelf", 3900.0, 0.0), ("high_shelf", 3900.0, 6.0), ("high_shelf", 5.0, 0.0), ("low_pass", 5.0, 0.0), ("high_pass", 3999.0, 0.0)):
        got = spark.range(1).select(signal.response_db(F.lit(f), signal.Band(kind, 500, 6.0, 0.8), rate).alias("o")).first().o
        assert abs(got - want) < 0.35, kind
    loud = signal.limited(tone * 4, rate)
    assert np.abs(loud).max() <= 0.98 + 1e-9 and np.allclose(signal.limited(tone, rate), tone)
    assert np.allclose(signal.resampled(tone, rate, rate), tone)
    up = signal.resampled(tone, rate, 16000)
    assert len(up) == 2 * len(tone) and np.allclose(up[::2][10:-10], tone[10:-10])
    assert abs(len(signal.stretched(tone, rate, 2.0)) / len(tone) - 0.5) < 0.05
    both = np.repeat(tone, 2, axis=1)
    assert signal.crossfed(both, rate).shape == both.shape and np.allclose(signal.crossfed(tone, rate), tone)
    assert abs(spark.range(1).select(signal.planned_gain_db(F.lit(6.0), F.lit(0.5), F.lit(0.0)).alias("o")).first().o - 5.0206) < 1e-3
    bits = signal.dsd_bits(bytes([0b00000001] * 4), 2, True)
    assert bits.shape == (16, 2) and bits[0, 0] == 1 and bits[1, 0] == 0
    assert np.allclose(signal.decimated(np.ones((4096, 1)), 16)[80:-80], 1.0, atol=1e-6)
    assert signal.worst_boost_db(spark, [signal.Band("peaking", 1000, 6.0, 1.0)], 44100).first().boost_db > 5.9
    assert np.allclose(signal.ramped(np.ones((4, 1)), 0.0, 1.0, 4)[:, 0], [0.25, 0.5, 0.75, 1.0])
    assert np.allclose(signal.processed(both, rate, {"preamp": 0.0, "volume": 0.5, "guard": 0.1}), np.clip(both * 0.5, -0.1, 0.1))
    assert signal.meter(tone, rate, 800)[-1] > 0.12 and np.abs(signal.saturated(tone * 0.01)).max() < 0.011
    blocks = spark.createDataFrame([(1, 1, 1, rate, tone[8000:, 0].tolist()), (1, 0, 1, rate, tone[:8000, 0].tolist())], "stream long, block_no long, channels int, sample_rate int, samples array<double>")
    assert [r.energy for r in signal.measured_energies(blocks).orderBy("block").collect()] == signal.block_energies(signal.k_weighted(tone, rate), rate).tolist()


def test_folds(spark):
    t = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([10, 20, 0])], "k string, o int, v double")
    assert abs(analytic.ewma(t, "k", "o", "v").first().rate - 9.1) < 1e-9
    assert analytic.peak_hold(t, "k", "o", "v", 0.5).first().peak == 10.0
    h = spark.createDataFrame([("k", i, v) for i, v in enumerate([0.6, 0.5, 0.6, 0.71, None, 0.4])], "k string, o int, v double")
    assert [r.matched for r in analytic.hysteresis(h, "k", ["o"], "v", 0.5, 0.7).orderBy("o").collect()] == [False, True, True, False, False, True]
    f = spark.createDataFrame([("a", 5, 1), ("b", 6, 2), ("c", 4, 3)], "name string, size long, used_at long")
    assert sorted(r.name for r in analytic.within_budget(f, 10).collect()) == ["b", "c"] and sorted(r.name for r in analytic.within_budget(f, 9, "a").collect()) == ["a", "c"]


def test_shuffle_keeps_what_is_playing(spark):
    rows = spark.range(50).withColumnRenamed("id", "k")
    one = {r.k: r.position for r in relational.shuffled(rows, 3, "k", current=17).collect()}
    two = {r.k: r.position for r in relational.shuffled(rows.repartition(5), 3, "k", current=17).collect()}
    assert one == two and one[17] == 0 and sorted(one.values()) == list(range(50)) and [k for k, _ in sorted(one.items(), key=lambda x: x[1])] != [17, *[k for k in range(50) if k != 17]]


def test_labels_that_do_not_settle(spark):
    import pytest

    albums = spark.createDataFrame([(i, f"t{i // 2}", "a") for i in range(40)], "id long, title_key string, artist_key string")
    tracks = spark.createDataFrame([(i, "f") for i in range(40)], "album_id long, folder string")
    with pytest.raises(RuntimeError, match="settle"):
        entities.consolidated(albums, tracks, most_rounds=1)
