from pyspark.sql import functions as F

from tonearm.operators import changes, services


def test_positions_keep_dismissed_until_moved(spark):
    old = spark.createDataFrame([(1, 1, 5, 1, True), (2, 1, 5, 1, True)], "book_id long, user_id long, book_offset_ms long, updated_at long, dismissed boolean")
    new = spark.createDataFrame([(1, 1, 5, 9), (2, 1, 6, 8), (2, 1, 7, 9), (3, 1, 1, 1)], "book_id long, user_id long, book_offset_ms long, updated_at long")
    got = sorted(map(tuple, services.saved_positions(old, new).collect()))
    assert got == [(1, 1, 5, 9, True), (2, 1, 7, 9, False), (3, 1, 1, 1, False)]


def test_bookmarks_listeners_lookups(spark):
    marks = spark.createDataFrame([(1, 50, "a"), (2, 10, "b")], "id long, offset_ms long, note string")
    patch = spark.createDataFrame([(1, None, "c"), (2, 99, None)], "id long, offset_ms long, note string")
    assert [tuple(r) for r in services.patched_bookmarks(marks, patch).collect()] == [(1, 50, "c"), (2, 99, "b")]
    people = spark.createDataFrame([(1, "bob", False), (2, "Ann", False), (3, "zed", True)], "id long, name string, is_default boolean")
    assert [r.id for r in services.listeners(people).orderBy("place").collect()] == [3, 2, 1]
    albums = spark.createDataFrame([(1, "not_found", 3), (2, "failed", 2), (3, "failed", 3), (4, "pending", 0)], "id long, enrich_status string, enrich_attempts int")
    assert sorted(r.id for r in services.due_for_lookup(albums).collect()) == [2, 4]
    assert [tuple(r) for r in services.pending_again(albums).where("id = 1").collect()] == [(1, "pending", 0)]


def test_files_and_roots(spark):
    e = spark.createDataFrame([(1, "/a"), (2, "/b"), (3, None)], "id long, file_path string")
    assert sorted(map(tuple, services.still_on_disk(e, spark.createDataFrame([("/a",)], "path string")).collect())) == [(1, "/a"), (2, None), (3, None)]
    books = spark.createDataFrame([(1, 1), (2, 2)], "book_id long, root_id long")
    parts = spark.createDataFrame([(1, 0), (2, 0)], "book_id long, part_index int")
    left, (rest,) = services.without_root(books, [parts], 1)
    assert [r.book_id for r in left.collect()] == [2] and [r.book_id for r in rest.collect()] == [2]


def test_sorting_and_snapshots(spark):
    t = spark.createDataFrame([(1, "Öl 10"), (2, "ol 9"), (3, "Zebra"), (4, "apple")], "id long, n string")
    assert [r.id for r in services.sorted_like_a_client(t, "n", "id").collect()] == [4, 2, 1, 3]
    docs = services.snapshot_json(t, "id").unionByName(spark.createDataFrame([(9, "junk")], "id long, json string"))
    assert sorted(map(tuple, services.from_snapshot(docs, "id long, n string", "id").collect())) == sorted(map(tuple, t.collect()))


def test_cache_goes_stale(spark):
    day = 86_400_000
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    cache = spark.createDataFrame([("a", "x", 10 * day), ("b", "y", 8 * day)], "key string, body string, fetched_at long")
    got = {r.key: (r.body, r.fresh) for r in changes.cached_lookup(asked, cache, 11 * day).collect()}
    assert got == {"a": ("x", True), "b": ("y", False), "c": (None, False)}


def test_scan(spark):
    known = spark.createDataFrame([("a", 1, 1, "A", 1, "h", False), ("b", 1, 1, "B", 1, "h", False), ("c", 1, 1, "C", 1, "h", False)], "path string, size long, mtime long, title string, album_id long, hash string, missing boolean")
    files = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], "path string, size long, mtime long")
    tags = spark.createDataFrame([("b", "B2", 2, None), ("d", "D", 3, None)], "path string, title string, album_id long, hash string")
    rows, report = services.scanned(known, files, tags)
    assert {r.path: (r.title, r.missing) for r in rows.collect()} == {"a": ("A", False), "b": ("B2", False), "c": ("C", True), "d": ("D", False)}
    assert {r.action: r["count"] for r in report.collect()} == {"skip": 1, "update": 1, "add": 1, "missing": 1}
    assert rows.where(F.col("hash").isNull()).count() == 2
