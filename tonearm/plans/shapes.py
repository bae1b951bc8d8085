"""Order-dependent shapes, data changes, entities and scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tonearm.functions import names, text
from tonearm.operators import analytic, bucketed, changelog, changes, entities, fuzzy, sessions, signal
from tonearm.plans.registry import query
from tonearm.sources import feeds

PARTS = ["l_linenumber", "l_partkey", "l_suppkey"]


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset_ms FROM lineitem")
def start_offsets(t):
    parts = t.lineitem.withColumn("d", F.col("l_quantity").cast("long"))
    return analytic.start_offsets(parts, "l_orderkey", PARTS, "d").select("l_orderkey", "l_linenumber", "l_partkey", "start_offset_ms")


@query("SELECT event_id, greatest(0, coalesce(lead((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 1767225600000) - (epoch_us(ts) // 1000)) AS duration_ms FROM events")
def chapter_durations(t):
    c = t.events.select("event_id", "user_id", F.unix_millis("ts").alias("start"), F.lit(1767225600000).alias("end"))
    return analytic.chapter_durations(c, "user_id", "start", "end", ["start", "event_id"]).select("event_id", "duration_ms")


@query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def history_dedup_lag(t):
    return analytic.changed_rows(t.events, "user_id", ["ts", "event_id"], "event_type").select("event_id")


@query("""WITH e AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) ms, lag((epoch_us(ts) // 1000)) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(CASE WHEN before IS NULL OR ms - before > 21600000 OR ms // 86400000 <> before // 86400000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id) - 1 AS seq FROM e)
SELECT user_id, CAST(seq AS BIGINT) AS seq, min(ms) AS started_at, max(ms) AS ended_at FROM b GROUP BY 1, 2""")
def sessions_by_fold(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    moves = t.events.select(F.lit(1).cast("long").alias("book_id"), "user_id", F.row_number().over(w).cast("long").alias("offset_ms"), F.unix_millis("ts").alias("now_ms"), F.lit(0).cast("long").alias("duration_ms"))
    return sessions.fold_sessions(moves, 6 * 3_600_000).select("user_id", "seq", "started_at", "ended_at")


_PLACES = """WITH RECURSIVE e AS (SELECT event_id % 2 AS b, user_id AS u, epoch_us(ts) // 1000 AS t, CASE WHEN event_id % 7 = 0 THEN 0 ELSE least(greatest(CAST(floor(value) AS BIGINT) * 10 - 50, 0), 600 * (event_id % 2) + 400) END AS o, 600 * (event_id % 2) + 400 AS d FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY b, u ORDER BY t, o) AS r FROM e),
f AS (SELECT b, u, r, t, o, CAST(1 AS BIGINT) AS seq, t AS st, t AS en, o AS so, o AS eo, CASE WHEN o >= 0.97 * d THEN t END AS fin FROM n WHERE r = 1
UNION ALL SELECT b, u, r, t, o, seq + CASE WHEN NOT cont AND moved THEN 1 ELSE 0 END, CASE WHEN NOT cont AND moved THEN t ELSE st END, CASE WHEN cont OR moved THEN t ELSE en END, CASE WHEN NOT cont AND moved THEN po ELSE so END, CASE WHEN cont OR moved THEN o ELSE eo END,
CASE WHEN o >= 0.97 * d THEN coalesce(fin, t) END FROM (SELECT n.b, n.u, n.r, n.t, n.o, n.d, f.o AS po, f.seq, f.st, f.en, f.so, f.eo, f.fin, n.t - f.en <= 21600000 AND n.t // 86400000 = f.en // 86400000 AS cont, n.o <> f.o AS moved FROM f JOIN n ON n.b = f.b AND n.u = f.u AND n.r = f.r + 1)) """


def _listening(t):
    """Updates of two books of 400 and 1,000 ms, some beyond their end, some back at the start."""
    e = F.col("event_id")
    offset = F.when(e % 7 == 0, 0).otherwise(F.floor("value") * 10 - 50)
    length = 600 * (e % 2) + 400
    clamped = F.least(F.greatest(offset, F.lit(0)), length)  # only to order updates of one millisecond as the SQL does
    return t.events.select((e % 2).alias("book_id"), "user_id", F.when(offset == clamped, offset).when(offset < 0, F.lit(-5)).otherwise(length + 5).alias("offset_ms"), F.unix_millis("ts").alias("now_ms"), length.alias("duration_ms"))


@query(_PLACES + "SELECT b AS book_id, u AS user_id, seq - 1 AS seq, max_by(st, r) AS started_at, max_by(en, r) AS ended_at, max_by(so, r) AS start_offset_ms, max_by(eo, r) AS end_offset_ms FROM f GROUP BY 1, 2, 3")
def sessions_with_durations(t):
    """Listening sessions with clamped places: each opens at the place saved before it."""
    return sessions.fold_sessions(_listening(t), 6 * 3_600_000).drop("open")


@query(_PLACES + "SELECT b AS book_id, u AS user_id, max_by(o, r) AS offset_ms, max(t) AS updated_at, arg_max_null(fin, r) AS finished_at, max(seq) AS sessions FROM f GROUP BY 1, 2")
def places_by_fold(t):
    """Saved places, finished at 97 % and unfinished by going back."""
    return sessions.fold_places(_listening(t), 6 * 3_600_000)


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS position FROM conversations")
def playlist_dense_positions(t):
    return analytic.dense_positions(t.conversations.select("conv_id", "turn"), "conv_id", [F.desc("turn")]).withColumn("position", F.col("position").cast("long"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r = 1")
def latest_row(t):
    return analytic.latest_per_group(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderdate, o_orderkey) r, count(*) OVER (PARTITION BY o_custkey) n FROM orders) WHERE r <= n - 3")
def keep_newest_n(t):
    return analytic.excess_beyond_newest(t.orders, "o_custkey", F.lit(3), [F.col("o_orderstatus") != "F", "o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS target FROM events")
def sliding_minimum(t):
    keyed = t.events.withColumn("at", F.struct("ts", "event_id"))
    return analytic.sliding_minimum(keyed, "user_id", "at", "value", 5).select("event_id", "target")


@query("""WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) r FROM events), f AS (SELECT user_id, r, value AS rate FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.r, f.rate * (1 - 0.3::DOUBLE) + e.value * 0.3::DOUBLE FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
SELECT user_id, round(max_by(rate, r), 6) AS rate FROM f GROUP BY 1""")
def rate_ewma(t):
    keyed = t.events.withColumn("at", F.struct("ts", "event_id"))
    return analytic.ewma(keyed, "user_id", "at", "value").select("user_id", F.round("rate", 6).alias("rate"))


@query("""WITH e AS (SELECT *, CASE WHEN value <= 50 THEN true WHEN value > 70 THEN false END AS d FROM events)
SELECT event_id, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS matched FROM e""")
def hysteresis_state(t):
    return analytic.hysteresis(t.events, "user_id", ["ts", "event_id"], "value", 50.0, 70.0).select("event_id", "matched")


@query("SELECT CAST(ts AS DATE) AS day, CAST(sum(greatest(0, CAST(floor(value) AS BIGINT) - event_id % 50)) AS BIGINT) AS listened_ms, max_by(CAST(floor(value) AS BIGINT), (ts, event_id)) AS stopped_at_ms FROM events GROUP BY 1")
def history_by_day(t):
    s = t.events.select(F.col("event_id").alias("id"), F.unix_millis("ts").alias("started_at"), F.unix_micros("ts").alias("ended_at"), (F.col("event_id") % 50).alias("start_offset_ms"), F.floor("value").alias("end_offset_ms"))
    return analytic.listened_by_day(s)


@query("SELECT doc_id FROM (SELECT doc_id, sum(length(text)) OVER (ORDER BY doc_id DESC) s FROM documents) WHERE s <= 100000")
def cache_within_budget(t):
    files = t.documents.select(F.col("doc_id").cast("string").alias("name"), F.length("text").alias("size"), F.col("doc_id").alias("used_at"))
    return analytic.within_budget(files, 100_000).select(F.col("name").cast("long").alias("doc_id"))


def _old_new(t):
    old = t.orders.where("o_orderkey % 5 <> 0").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = t.orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise(F.lit("X")).alias("o_orderstatus"), "o_totalprice")
    return old, new


OLD_NEW = """WITH old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0), new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'X' END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 = 0) """


@query(OLD_NEW + "SELECT o_orderkey, coalesce(new.o_orderstatus, old.o_orderstatus) AS o_orderstatus, coalesce(new.o_totalprice, old.o_totalprice) AS o_totalprice FROM old FULL JOIN new USING (o_orderkey)")
def upsert_merge(t):
    return changes.upserted(*_old_new(t), ["o_orderkey"])


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 500 = 0 THEN 'M' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE (o_orderkey % 5 <> 0 OR o_orderkey % 500 = 0) AND o_orderkey % 1000 <> 1""")
def merged_in_buckets(t):
    """A few rows merged into a stored table and a few deleted: only their buckets are written again."""
    old, _ = _old_new(t)
    table = bucketed.BucketedTable.created(old, ["o_orderkey"], 64)
    new = t.orders.where("o_orderkey % 500 = 0").select("o_orderkey", F.lit("M").alias("o_orderstatus"), "o_totalprice")
    table.merged(new)
    table.deleted(t.orders.where("o_orderkey % 1000 = 1"))
    return table.rows()


@query("SELECT o_orderkey, lower(o_orderstatus) AS o_orderstatus, round(o_totalprice) AS o_totalprice FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderstatus <> 'P'")
def table_rebuilt(t):
    """A stored table rebuilt from a selection of itself, then swapped in."""
    table = bucketed.BucketedTable.created(_old_new(t)[0], ["o_orderkey"], 8)
    table.rebuilt(lambda old: old.where("o_orderstatus <> 'P'").withColumn("o_orderstatus", F.lower("o_orderstatus")).withColumn("o_totalprice", F.round("o_totalprice")))
    return table.rows()


@query(OLD_NEW + "SELECT * FROM old UNION ALL SELECT * FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)")
def insert_or_ignore(t):
    return changes.inserted_if_absent(*_old_new(t), ["o_orderkey"])


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 20 THEN p_brand END, CASE WHEN p_partkey % 2 = 0 THEN p_type END) AS label FROM part")
def fill_blanks(t):
    old = t.part.select("p_partkey", F.when(F.col("p_size") > 20, F.col("p_brand")).alias("label"))
    new = t.part.where("p_partkey % 2 = 0").select("p_partkey", F.col("p_type").alias("label"))
    return changes.blanks_filled(old, new, "p_partkey", ["label"])


@query(OLD_NEW + "SELECT new.* FROM new LEFT JOIN old USING (o_orderkey) WHERE old.o_orderkey IS NULL OR old.o_orderstatus IS DISTINCT FROM new.o_orderstatus")
def write_if_changed(t):
    return changes.really_changed(*_old_new(t), "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query(OLD_NEW + "SELECT o_orderkey, o_orderkey NOT IN (SELECT o_orderkey FROM new) AS missing FROM old")
def soft_delete(t):
    old, new = _old_new(t)
    return changes.marked_missing(old.select("o_orderkey"), new, "o_orderkey")


@query(OLD_NEW + "SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN new.o_orderkey IS NULL THEN 'missing' WHEN old.o_orderkey IS NULL THEN 'add' WHEN old.o_orderstatus IS NOT DISTINCT FROM new.o_orderstatus THEN 'skip' ELSE 'update' END AS action FROM old FULL JOIN new USING (o_orderkey)")
def incremental_scan_plan(t):
    side = lambda d: d.select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_totalprice").alias("size"), F.col("o_orderstatus").alias("mtime"))
    return changes.scan_plan(*map(side, _old_new(t)))


@query(OLD_NEW + "SELECT o_orderkey, 'changed' AS kind FROM (SELECT new.* FROM new LEFT JOIN old USING (o_orderkey) WHERE old.o_orderkey IS NULL OR old.o_orderstatus IS DISTINCT FROM new.o_orderstatus) UNION ALL SELECT o_orderkey, 'gone' FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)")
def catalog_delta(t):
    changed, gone = changes.change_feed(*_old_new(t), "o_orderkey", ["o_orderstatus", "o_totalprice"], 2)
    return changed.select("o_orderkey", F.lit("changed").alias("kind")).unionByName(gone.select(F.col("id").alias("o_orderkey"), F.lit("gone").alias("kind")))


@query(OLD_NEW + "SELECT * FROM new")
def delta_round_trip(t):
    old, new = _old_new(t)
    changed, gone = changes.change_feed(old, new, "o_orderkey", ["o_orderstatus", "o_totalprice"], 2)
    return changes.delta_applied(old, changed.withColumn("missing", F.lit(False)), gone.select("id"), "o_orderkey")


def _log(t, states):
    """A log of orders through so many of five states; only the status is shown."""
    k, s, p = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_totalprice")
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    one = rows.where(k % 5 != 0)
    edited = rows.select("o_orderkey", F.when(k % 100 == 1, "X").otherwise(s).alias("o_orderstatus"), F.when(k % 100 == 2, p + 1).otherwise(p).alias("o_totalprice"))
    two, three = edited.where(k % 5 != 0), edited.where(((k % 5 != 0) & (k % 50 != 3)) | (k % 200 == 0))
    four = three.withColumn("o_orderstatus", F.when(k % 3 == 1, "Y").otherwise(s))
    five = four.where(k % 50 != 7).withColumn("o_orderstatus", F.when(k % 100 == 9, "Z").otherwise(s))
    log = changelog.ChangeLog.created(one, "o_orderkey", ["o_orderstatus"])
    for state in (two, three, four, five)[: states - 1]:
        log.record(state)
    return log


_THREE = "SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 100 = 2 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE (o_orderkey % 5 <> 0 AND o_orderkey % 50 <> 3) OR o_orderkey % 200 = 0"


@query("""WITH k AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders), x AS (
SELECT 'three' AS at, 1 AS since, 'rows' AS kind, count(*) FILTER ((k % 5 <> 0 AND k % 50 <> 3 AND k % 100 = 1 AND s <> 'X') OR k % 200 = 0) AS changed, count(*) FILTER (k % 50 = 3) AS removed FROM k
UNION ALL SELECT 'three', 2, 'rows', count(*) FILTER (k % 200 = 0), count(*) FILTER (k % 50 = 3) FROM k UNION ALL SELECT 'three', 3, 'none', 0, 0 UNION ALL SELECT 'three', 4, 'full', 0, 0 UNION ALL SELECT 'three', -1, 'full', 0, 0 UNION ALL SELECT 'another', 1, 'full', 0, 0
UNION ALL SELECT 'five', 1, 'full', 0, 0 UNION ALL SELECT 'five', 3, 'full', 0, 0 UNION ALL SELECT 'five', 4, 'rows', count(*) FILTER (k % 100 = 9), count(*) FILTER (k % 50 = 7) FROM k UNION ALL SELECT 'five', 5, 'none', 0, 0) SELECT * FROM x""")
def revision_deltas(t):
    """How replicas at several revisions catch up, before and after a compaction."""
    out, log = [], _log(t, 3)
    asked = [("three", log, log.catalogue_id, n) for n in (1, 2, 3, 4, -1)] + [("another", log, "0" * 32, 1)]
    later = _log(t, 4)
    later.compacted()
    later.record(_log(t, 5).current().drop("rev"))
    asked += [("five", later, later.catalogue_id, n) for n in (1, 3, 4, 5)]
    for at, log, name, since in asked:
        d = log.delta(name, since)
        out.append((at, since, d.kind, d.changed.count() if d.changed else 0, d.removed.count() if d.removed else 0))
    return t.spark.createDataFrame(out, "at string, since int, kind string, changed long, removed long")


@query(_THREE)
def replica_caught_up(t):
    """A replica of the first revision after a delta of the third, through a compaction."""
    log = _log(t, 2)
    replica = log.current().drop("rev").withColumn("o_totalprice", F.col("o_totalprice"))
    first = log.revision()
    log.record(_log(t, 3).current().drop("rev"))
    log.compacted()
    return changelog.caught_up(replica, log.delta(log.catalogue_id, first), "o_orderkey", log)


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 10 = 1 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 10 = 2 AND doc_id > 50 ORDER BY 1")
def removed_rows(t):
    stones = t.documents.where("doc_id % 10 = 1").select(F.col("doc_id").alias("id"), F.lit(9).alias("rev"))
    tracks = t.documents.where("doc_id % 10 <> 1").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") > 50, 9).otherwise(1).alias("rev"), F.when(F.col("doc_id") % 10 == 2, F.lit(1)).alias("duplicate_of"))
    return changes.removed_rows(stones, tracks, 5)


@query("WITH k AS (SELECT md5(text) h, lang l, min(doc_id) m, count(*) n FROM documents GROUP BY 1, 2) SELECT doc_id, m AS duplicate_of FROM documents JOIN k ON md5(text) = h AND lang = l WHERE doc_id <> m")
def duplicate_keeper(t):
    docs = t.documents.select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return entities.duplicate_keepers(docs, ["lang", "hash"], "doc_id").where("duplicate_of IS NOT NULL").select("doc_id", "duplicate_of")


@query("""WITH c AS (SELECT conv_id, string_agg(md5(role), ',' ORDER BY turn) k, max(turn) p FROM conversations GROUP BY 1), r AS (SELECT conv_id, first_value(conv_id) OVER w AS keep FROM c WINDOW w AS (PARTITION BY k ORDER BY p DESC NULLS LAST, conv_id))
SELECT conv_id AS book_id, keep AS duplicate_of FROM r WHERE conv_id <> keep""")
def book_duplicates(t):
    parts = t.conversations.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("part_index"), F.sha2(F.col("role").cast("binary"), 256).alias("hash"))
    books = t.conversations.groupBy(F.col("conv_id").alias("book_id")).agg(F.max("turn").alias("last_played"))
    return entities.book_duplicates(parts, books)


@query("""WITH RECURSIVE a AS (SELECT c_custkey id, c_mktsegment || (c_custkey % 40) tk, c_nationkey ak, c_custkey % 97 f FROM customer), e AS (SELECT x.id i, min(y.id) j FROM a x JOIN a y ON x.tk = y.tk AND (x.ak = y.ak OR x.f = y.f) GROUP BY 1),
p AS (SELECT DISTINCT x.id i, y.id j FROM a x JOIN a y ON x.tk = y.tk AND (x.ak = y.ak OR x.f = y.f)), r AS (SELECT id i, id root FROM a UNION SELECT p.j, r.root FROM r JOIN p ON p.i = r.i AND p.j > r.root)
SELECT i AS album_id, min(root) AS survivor FROM r GROUP BY 1""")
def album_consolidation(t):
    albums = t.customer.select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", (F.col("c_custkey") % 40).cast("string")).alias("title_key"), F.col("c_nationkey").cast("string").alias("artist_key"))
    tracks = t.customer.select(F.col("c_custkey").alias("album_id"), (F.col("c_custkey") % 97).cast("string").alias("folder"))
    return entities.consolidated(albums, tracks)


@query("SELECT doc_id FROM documents WHERE len(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: regexp_replace(w, '[^\\p{L}\\p{N}_-]', '', 'g') LIKE 'th%')) > 0 AND len(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: regexp_replace(w, '[^\\p{L}\\p{N}_-]', '', 'g') LIKE 'nd%')) > 0")
def bm25_search(t):
    return entities.search(t.text_index, t.documents, "th nd", "doc_id", most=None).select("doc_id")


@query("""WITH p AS (SELECT x.p_partkey a, y.p_partkey b, (1.0 - levenshtein(x.p_name, y.p_name)::DOUBLE / greatest(length(x.p_name), length(y.p_name)))::FLOAT c FROM part x JOIN part y ON x.p_partkey <> y.p_partkey)
SELECT a, b, round(c::DOUBLE, 5) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b DESC) r FROM p) WHERE r = 1 AND c >= 0.3""")
def levenshtein_match(t):
    """The best match of each part among all other parts."""
    best = fuzzy.other_row_matches(t.part, "p_partkey", "p_name", 0.3)
    return best.select("a", "b", F.round(F.col("similarity").cast("double"), 5).alias("confidence"))


@query("""WITH u AS (SELECT DISTINCT o_orderpriority || ' ' || o_orderstatus AS s FROM orders)
SELECT x.s AS a, y.s AS b, round((1.0 - levenshtein(x.s, y.s)::DOUBLE / greatest(length(x.s), length(y.s)))::FLOAT::DOUBLE, 5) AS similarity FROM u x, u y WHERE 1.0 - levenshtein(x.s, y.s)::DOUBLE / greatest(length(x.s), length(y.s)) >= 0.55""")
def similar_labels(t):
    """All pairs of labels that are 0.55 alike or more, by the segment index."""
    labels = t.orders.select(F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"))
    return fuzzy.similar(labels, labels, 0.55).select("a", "b", F.round(F.col("similarity").cast("double"), 5).alias("similarity"))


@query("SELECT p_partkey, lower(trim(regexp_replace('  ' || upper(p_name) || '   x ', '\\s+', ' ', 'g'))) AS k FROM part")
def group_key(t):
    return t.part.select("p_partkey", names.group_key(F.concat(F.lit("  "), F.upper("p_name"), F.lit("   x "))).alias("k"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ', The' WHEN p_partkey % 3 = 1 THEN p_name || ', a' ELSE 'Theory ' || p_name END AS k FROM part")
def sort_key(t):
    n, m = F.col("p_name"), F.col("p_partkey") % 3
    title = F.when(m == 0, F.concat(F.lit(" The  "), n)).when(m == 1, F.concat(F.lit("a "), n)).otherwise(F.concat(F.lit("Theory "), n))
    return t.part.select("p_partkey", names.sort_key(title).alias("k"))


@query("SELECT o_orderkey, CASE WHEN year(o_orderdate) + (o_orderkey % 60) - 30 BETWEEN 1900 AND 2001 THEN year(o_orderdate) + (o_orderkey % 60) - 30 END AS y FROM orders")
def sane_year(t):
    return t.orders.select("o_orderkey", names.sane_year(F.year("o_orderdate") + F.col("o_orderkey") % 60 - 30, 2000).alias("y"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN [c_name, c_mktsegment] ELSE [c_name || '/' || c_mktsegment, 'Guest'] END AS artists FROM customer")
def split_artists(t):
    tag = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(" / "), "c_mktsegment", F.lit("; "), F.upper("c_name"))).otherwise(F.concat("c_name", F.lit("/"), "c_mktsegment", F.lit(" (feat. Guest)")))
    return t.customer.select("c_custkey", names.split_artists(tag).alias("artists"))


ALIASES, KEYWORDS = [("smallplate", "Plated"), ("economy", "Economy")], [("ring", "Ring"), ("hotrod", "Hot Rod"), ("large", "Large"), ("rod", "Rod")]


def _raw_genres(t):
    """A raw genre tag for each part: lists, brackets, addresses, numbers."""
    n, y, k = F.col("p_name"), F.col("p_type"), F.col("p_partkey")
    forms = [n, F.concat(n, F.lit(" / "), y), F.concat(F.lit("http://x/"), n), F.concat(F.lit("Genre "), k % 50), F.concat(y, F.lit("; "), n, F.lit(" (live [x] y)")), F.concat(F.replace(n, F.lit(" "), F.lit("_")), F.lit(" - "), n)]
    return t.part.select(k.alias("id"), F.element_at(F.array(*forms), (k % 6 + 1).cast("int")).alias("raw"))


def _genres(t):
    return entities.genre_map(_raw_genres(t), t.spark.createDataFrame(ALIASES, "key string, genre string"), t.spark.createDataFrame(KEYWORDS, "word string, genre string"))


_GENRES = """WITH p AS (SELECT p_partkey % 6 AS m, p_name AS n, p_type AS y, p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' / ' || p_type WHEN 2 THEN 'http://x/' || p_name WHEN 3 THEN 'Genre ' || p_partkey % 50 WHEN 4 THEN p_type || '; ' || p_name || ' (live [x] y)' ELSE replace(p_name, ' ', '_') || ' - ' || p_name END AS raw FROM part),
v AS (SELECT DISTINCT raw, 0 AS i, CASE WHEN m = 4 THEN y ELSE n END AS clean FROM p WHERE m NOT IN (2, 3) UNION SELECT DISTINCT raw, 1, CASE WHEN m = 1 THEN y ELSE n END FROM p WHERE m IN (1, 4, 5)),
a AS (SELECT raw, i, 0 AS j, CASE lower(replace(clean, ' ', '')) WHEN 'smallplate' THEN 'Plated' ELSE 'Economy' END AS genre, 'alias' AS how FROM v WHERE lower(replace(clean, ' ', '')) IN ('smallplate', 'economy')),
rest AS (SELECT * FROM v ANTI JOIN a USING (raw, i)), w AS (SELECT raw, i, string_split(lower(clean), ' ') AS s FROM rest), l AS (SELECT raw, i, s || CASE WHEN len(s) = 2 THEN [s[1] || s[2]] ELSE [] END AS s FROM w),
k AS (SELECT raw, i, j - 1 AS j, CASE s[j] WHEN 'ring' THEN 'Ring' WHEN 'hotrod' THEN 'Hot Rod' WHEN 'rod' THEN 'Rod' ELSE 'Large' END AS genre, 'keyword' AS how FROM (SELECT raw, i, s, unnest(range(1, len(s) + 1)) AS j FROM l) WHERE s[j] IN ('ring', 'hotrod', 'rod', 'large')),
u AS (SELECT raw, i, 0 AS j, CASE WHEN clean = upper(clean) THEN clean ELSE upper(clean[1]) || split_part(clean, ' ', 1)[2:] || ' ' || upper(split_part(clean, ' ', 2)[1]) || split_part(clean, ' ', 2)[2:] END AS genre, 'unmapped' AS how FROM rest ANTI JOIN k USING (raw, i)),
every AS (SELECT * FROM a UNION ALL SELECT * FROM k UNION ALL SELECT * FROM u), g AS (SELECT raw, genre, arg_min(how, i * 100 + j) AS how, min(i * 100 + j) AS place FROM every GROUP BY 1, 2) """


@query(_GENRES + "SELECT raw, genre, how FROM g")
def genre_map(t):
    return _genres(t).select("raw", "genre", "how")


@query(_GENRES + "SELECT p.id, g.genre FROM p JOIN g USING (raw) WHERE p.id % 10 > 0 GROUP BY 1, 2")
def track_genre_links(t):
    """Links of present tracks to their genres."""
    tracks = _raw_genres(t).withColumn("missing", F.col("id") % 10 == 0).withColumn("duplicate_of", F.lit(None).cast("long"))
    return entities.track_genres(tracks, _genres(t))


@query(_GENRES + ", n AS (SELECT raw, list(genre ORDER BY place) AS genres, max(how) AS how FROM g GROUP BY 1), c AS (SELECT raw, count(*) AS n FROM p GROUP BY 1), r AS (SELECT raw, c.n AS count, coalesce(genres, []) AS genres, coalesce(how, 'ignored') AS how FROM c LEFT JOIN n USING (raw)) "
"SELECT * FROM (SELECT * FROM r WHERE how = 'unmapped' ORDER BY count DESC, raw LIMIT 200) UNION ALL SELECT * FROM (SELECT * FROM r WHERE how = 'keyword' ORDER BY count DESC, raw LIMIT 200) UNION ALL SELECT * FROM (SELECT * FROM r WHERE how = 'ignored' ORDER BY count DESC, raw LIMIT 200)")
def raw_genre_report(t):
    """The most frequent raw tags by how they were mapped."""
    tracks = _raw_genres(t).withColumn("missing", F.lit(False)).withColumn("duplicate_of", F.lit(None).cast("long"))
    parts = [entities.genre_report(tracks, _genres(t), how).withColumn("how", F.lit(how)) for how in ("unmapped", "keyword", "ignored")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT event_id, nullif(CASE WHEN event_id % 4 = 0 THEN CAST((event_id % 3600) * 1000 AS BIGINT) WHEN event_id % 4 = 1 THEN CAST((event_id % 100 * 60 + event_id % 60) * 1000 AS BIGINT) WHEN event_id % 4 = 2 THEN CAST((event_id % 10 * 3600 + event_id % 60 * 60 + 30) * 1000 AS BIGINT) END, 0) AS ms FROM events")
def duration_text(t):
    e, m = F.col("event_id"), F.col("event_id") % 4
    s = F.when(m == 0, (e % 3600).cast("string")).when(m == 1, F.concat_ws(":", (e % 100).cast("string"), (e % 60).cast("string"))).when(m == 2, F.concat_ws(":", (e % 10).cast("string"), (e % 60).cast("string"), F.lit("30"))).otherwise(F.lit("1:2:3:4"))
    return t.events.select("event_id", text.duration_ms(s).alias("ms"))


@query("SELECT event_id, CAST((epoch_us(ts) // 1000) // 86400000 AS BIGINT) AS day, strftime(ts, '%Y-%m-%d') AS date FROM events")
def utc_days(t):
    ms = F.unix_millis("ts")
    return t.events.select("event_id", text.utc_day(ms).alias("day"), text.utc_date(ms).alias("date"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice >= l_quantity * 1500 * 0.97::DOUBLE AS finished, CASE WHEN l_extendedprice >= l_quantity * 1500 * 0.97::DOUBLE THEN 0 ELSE l_extendedprice END AS at FROM lineitem")
def finished_and_restart(t):
    at, d = F.col("l_extendedprice"), F.col("l_quantity") * 1500
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", text.finished(at, d).alias("finished"), text.restart_at(at, d).alias("at"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^(https?://[^/]*)', 1)), ':(80|443)$', '') || regexp_replace(regexp_extract(url, '^https?://[^/]*([^#]*)', 1), '^/$', '') AS u FROM pages")
def feed_url(t):
    return t.pages.select("page_id", text.feed_url(F.col("url")).alias("u"))


@query("SELECT page_id, count(*) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href=')) FROM pages) GROUP BY 1")
def page_links(t):
    tags = F.regexp_extract_all("html", F.lit(r"<a\s[^>]*href="), F.lit(0))
    return t.pages.select("page_id", F.explode(tags)).groupBy("page_id").agg(F.count("*").alias("links"))


@query("SELECT doc_id, CASE WHEN h > 0 THEN h || ':' || lpad(m::VARCHAR, 2, '0') ELSE m::VARCHAR END || ':' || lpad(s::VARCHAR, 2, '0') AS clock FROM (SELECT doc_id, n_chars * 100 // 3600000 h, n_chars * 100 // 60000 % 60 m, n_chars * 100 // 1000 % 60 s FROM documents)")
def clock_label(t):
    return t.documents.select("doc_id", text.clock(F.col("n_chars") * 100).alias("clock"))


@query("SELECT n, k, round((SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)) / 2.0 ** n) FROM range(0, 31) r(i) WHERE i BETWEEN k AND n), 9) AS p FROM (SELECT n, k FROM range(1, 31) a(n), range(0, 31) b(k) WHERE k <= n)")
def abx_p_value(t):
    pairs = t.spark.range(1, 31).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id"))).alias("k"))
    return pairs.select("n", "k", F.round(text.binomial_tail(F.col("n"), F.col("k")), 9).alias("p"))


@query("""WITH e AS (SELECT label, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS e FROM embeddings), m AS (SELECT label, avg(e) FILTER (WHERE e > 10 ** ((-70 + 0.691) / 10.0)) m FROM e GROUP BY 1)
SELECT label, round(-0.691 + 10 * log10(avg(e)), 6) AS lufs FROM e JOIN m USING (label) WHERE e > 10 ** ((-70 + 0.691) / 10.0) AND e > 10 ** ((-0.691 + 10 * log10(m) - 10 + 0.691) / 10.0) GROUP BY 1""")
def gated_energy(t):
    e = t.embeddings.select("label", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("e"))
    return signal.gated_loudness(e, "label", "e").select("label", F.round("lufs", 6).alias("lufs"))


@query("SELECT vec_id, round(greatest(least(6.0, -20 * log10(p) - 3.0 - 1.0), -24.0), 6) AS gain FROM (SELECT vec_id, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) p FROM embeddings)")
def gain_plan(t):
    peak = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    return t.embeddings.select("vec_id", F.round(signal.planned_gain_db(F.lit(6.0), peak, F.lit(3.0)), 6).alias("gain"))


@query()
def k_weighted_energy(t):
    blocks = t.embeddings.select(F.col("label").cast("long").alias("stream"), F.col("vec_id").alias("block_no"), F.lit(1).alias("channels"), F.lit(1000).alias("sample_rate"), F.col("embedding").alias("samples"))
    return signal.measured_energies(blocks)


# Extensions: what the engine offers beyond the catalogue's own needs.
@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def ext_intersect(t):
    return t.orders.select(F.col("o_custkey").alias("k")).intersect(t.customer.where("c_acctbal > 0").select("c_custkey"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def ext_hourly_windows(t):
    return t.events.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("hour"), "n")


@query("SELECT c_mktsegment, c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS r FROM customer")
def ext_rank(t):
    return t.customer.select("c_mktsegment", "c_custkey", F.rank().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"))).cast("long").alias("r"))


def _episodes(t):
    e = t.events
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("feed_id"), F.concat(F.lit("g"), F.col("event_id").cast("string")).alias("guid"), F.col("event_type").alias("title"),
        F.concat(F.lit("http://x/"), (F.col("event_id") % 9000).cast("string")).alias("enclosure_url"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("/f/"), (F.col("event_id") % 6000).cast("string"))).alias("file_path"),
        F.when(F.col("event_id") % 4 == 0, F.unix_millis("ts")).alias("played_at"), F.unix_millis("ts").alias("published_at"), (F.col("event_id") % 11 == 0).alias("dropped"),
    )


def _feeds(t):
    users = t.events.select(F.col("user_id").alias("feed_id")).distinct()
    return users.select("feed_id", (F.col("feed_id") % 4).cast("int").alias("keep_n"), F.lit(30).alias("delete_played_after_days"), (F.col("feed_id") % 3 != 0).alias("auto_download"))


EPISODES = """WITH ep AS (SELECT event_id id, user_id feed_id, CASE WHEN event_id % 3 <> 0 THEN '/f/' || (event_id % 6000) END file_path, CASE WHEN event_id % 4 = 0 THEN epoch_us(ts) // 1000 END played_at, epoch_us(ts) // 1000 published_at, event_id % 11 = 0 dropped FROM events),
fd AS (SELECT DISTINCT user_id feed_id, CAST(user_id % 4 AS INTEGER) keep_n, user_id % 3 <> 0 auto_download FROM events) """


@query(EPISODES + "SELECT fd.feed_id, keep_n, 30 AS delete_played_after_days, auto_download, count(*) AS episodes, count(*) FILTER (WHERE played_at IS NULL AND NOT dropped) AS unplayed FROM fd JOIN ep USING (feed_id) GROUP BY ALL")
def feed_list(t):
    from tonearm.operators import services

    return services.feed_list(_feeds(t), _episodes(t))


@query(EPISODES + ", r AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY published_at DESC NULLS LAST, id DESC) r FROM ep JOIN fd USING (feed_id) WHERE auto_download AND played_at IS NULL AND NOT dropped) SELECT feed_id, id FROM r WHERE r <= greatest(keep_n, 1) AND file_path IS NULL")
def auto_download_pick(t):
    from tonearm.operators import services

    return services.to_download(_episodes(t), _feeds(t))


@query(EPISODES + """, o AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY played_at IS NULL, coalesce(published_at, 0), id) r, count(*) OVER (PARTITION BY feed_id) n FROM ep JOIN fd USING (feed_id) WHERE file_path IS NOT NULL AND auto_download)
SELECT id FROM ep WHERE file_path IS NOT NULL AND played_at < 1767225600000 - 30 * 86400000::BIGINT UNION SELECT id FROM o WHERE r <= n - greatest(keep_n, 1)""")
def feed_retention(t):
    from tonearm.operators import services

    return services.retention(_episodes(t), _feeds(t), 1_767_225_600_000)


@query(EPISODES + "SELECT id FROM ep WHERE file_path IN (SELECT file_path FROM ep GROUP BY 1 HAVING count(*) > 1)")
def path_collision(t):
    from tonearm.operators import services

    return services.path_collisions(_episodes(t)).select("id")


@query(EPISODES + "SELECT user_id AS feed_id, 'g' || event_id AS guid, 'http://x/' || CASE WHEN event_id % 3 <> 0 AND event_id % 2 = 0 THEN event_id % 9000 ELSE event_id % 100 END AS enclosure_url, FALSE AS dropped FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT user_id, 'g' || event_id, 'http://x/' || (event_id % 9000), TRUE FROM events WHERE event_id % 2 = 0 AND event_id % 5 = 0")
def feed_store(t):
    from tonearm.operators import services

    e = _episodes(t)
    known = e.where("id % 2 = 0").select("feed_id", "guid", "title", "enclosure_url", "file_path", "dropped").withColumn("dropped", F.lit(False))
    now = e.where("id % 5 <> 0").select("feed_id", "guid", "title", F.concat(F.lit("http://x/"), (F.col("id") % 100).cast("string")).alias("enclosure_url"))
    return services.stored_feed(known, now).select("feed_id", "guid", "enclosure_url", "dropped")


@query("SELECT o_orderkey AS book_id, CAST(o_orderkey % 1000 AS BIGINT) AS book_offset_ms, round((o_orderkey % 1000) / 1000.0::DOUBLE, 6) AS progress FROM orders WHERE o_custkey % 10 = 3 AND o_orderstatus <> 'P' AND o_orderkey % 1000 BETWEEN 1 AND 969")
def continue_shelf(t):
    from tonearm.operators import services

    books = t.orders.select(F.col("o_orderkey").alias("book_id"), F.lit(1000).cast("long").alias("duration_ms"))
    pos = t.orders.select(F.col("o_orderkey").alias("book_id"), (F.col("o_custkey") % 10).alias("user_id"), (F.col("o_orderkey") % 1000).alias("book_offset_ms"), F.unix_millis("o_orderdate").alias("updated_at"), (F.col("o_orderstatus") == "P").alias("dismissed"))
    return services.continue_shelf(books, pos, 3).select("book_id", "book_offset_ms", F.round("progress", 6).alias("progress"))


@query("SELECT action, count(*) AS n FROM (SELECT CASE WHEN event_id % 2 <> 0 THEN 'add' WHEN event_id % 5 = 0 THEN 'missing' WHEN event_id % 7 = 0 THEN 'update' ELSE 'skip' END AS action FROM events WHERE event_id % 2 = 0 OR event_id % 5 <> 0) GROUP BY 1")
def scan_report(t):
    from tonearm.operators import services

    e = t.events.select(F.col("event_id").alias("id"), F.col("event_id").cast("string").alias("path"), F.lit(1).alias("size"))
    known = e.where("id % 2 = 0").select("path", "size", F.lit(1).alias("mtime"), F.lit("t").alias("title"), F.lit(1).alias("album_id"), F.lit("h").alias("hash"), F.lit(False).alias("missing"))
    files = e.where("id % 5 <> 0").select("path", "size", F.when(F.col("id") % 7 == 0, 2).otherwise(1).alias("mtime"))
    tags = e.select("path", F.lit("u").alias("title"), F.lit(2).alias("album_id"), F.lit("k").alias("hash"))
    return services.scanned(known, files, tags)[1].select("action", F.col("count").alias("n"))


@query("SELECT p_partkey, p_name, p_size FROM part")
def snapshot_round_trip(t):
    from tonearm.operators import services

    docs = services.snapshot_json(t.part.select("p_partkey", "p_name", "p_size"), "p_partkey")
    return services.from_snapshot(docs, "p_partkey long, p_name string, p_size int", "p_partkey")


@query("SELECT c_custkey, replace(replace(replace(c_name || '<&>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS x FROM customer")
def xml_escaped(t):
    return t.customer.select("c_custkey", text.xml_escape(F.concat("c_name", F.lit("<&>"))).alias("x"))


@query("SELECT page_id, 'audio-' || page_id || '- x' AS f FROM pages")
def safe_file_name(t):
    return t.pages.select("page_id", text.safe_name(F.concat(F.lit(" audio/"), F.col("page_id").cast("string"), F.lit(":  x. ")), 60).alias("f"))


@query("SELECT doc_id, CASE WHEN n_chars * 100 < 1048576 THEN greatest(1, CAST(floor(n_chars * 100 / 1024.0 + 0.5) AS BIGINT)) || ' KB' ELSE format('{:.1f}', n_chars * 100 / 1048576.0::DOUBLE) || ' MB' END AS size FROM documents")
def size_label(t):
    return t.documents.select("doc_id", text.size_label(F.col("n_chars") * 100).alias("size"))


@query("SELECT o_orderkey, CASE WHEN f IN ('dsf', 'dff') OR f IS NULL THEN CASE WHEN p = 'opus' THEN 'opus' ELSE 'flac' END WHEN p = 'opus' THEN 'opus' ELSE 'passthrough' END AS target FROM (SELECT o_orderkey, ['mp3', 'flac', 'dsf', 'dff', NULL][CAST(o_orderkey % 5 AS INTEGER) + 1] f, ['opus', 'passthrough', NULL][CAST(o_orderkey % 3 AS INTEGER) + 1] p FROM orders)")
def transcode_ladder(t):
    k = F.col("o_orderkey")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs)).cast("int") + 1)
    return t.orders.select("o_orderkey", text.transcode_target(pick(["mp3", "flac", "dsf", "dff", None]), pick(["opus", "passthrough", None])).alias("target"))


@query("SELECT page_id, regexp_extract('/m/' || url || '/a.mp3', '^(.*)/[^/]+$', 1, 's') AS d FROM pages")
def parent_directory(t):
    return t.pages.select("page_id", names.parent_dir(F.concat(F.lit("/m/"), "url", F.lit("/a.mp3"))).alias("d"))


@query("SELECT p_partkey, trim(regexp_extract(p_name || ': ' || p_type, '^[^:(]*')) AS title FROM part")
def main_title(t):
    return t.part.select("p_partkey", names.main_title(F.concat("p_name", F.lit(": "), "p_type")).alias("title"))


@query("SELECT p_partkey, sha256(p_name) AS h FROM part")
def content_hash(t):
    return t.part.select("p_partkey", text.content_hash(F.col("p_name").cast("binary")).alias("h"))
