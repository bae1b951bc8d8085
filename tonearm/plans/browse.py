"""Catalogue browsing: pages, filters, joins, counts, sorts.

Stand-ins: albums = orders, tracks = lineitem, artists = customer; a track is present unless returned.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tonearm.functions import names, text
from tonearm.operators import analytic, orderindex, ordering, relational
from tonearm.plans.registry import query

PRESENT = "l_returnflag <> 'R'"


def _tracks(t):
    return t.lineitem.where(PRESENT)


@query("""SELECT o_orderkey, o_orderpriority, coalesce(n, 0) AS track_count FROM orders LEFT JOIN (SELECT l_orderkey, count(*) n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) ON l_orderkey = o_orderkey
ORDER BY o_orderpriority, o_orderkey LIMIT 100 OFFSET 100""")
def album_list_page(t):
    albums = t.orders.select("o_orderkey", "o_orderpriority")
    return relational.page_with_child_count(albums, ["o_orderpriority", "o_orderkey"], 2, 100, _tracks(t), "o_orderkey", "l_orderkey", "track_count")


@query("""SELECT o_orderkey, o_custkey, r AS place, n AS total FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) WHERE r >= (n // 100 - 1) * 100 AND r < n // 100 * 100""")
def late_page_indexed(t):
    """A page near the end of all orders, dearest first, through a stored order."""
    index = orderindex.ordered(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), [(F.col("o_totalprice"), False), (F.col("o_orderkey"), True)], 4000)
    total = index.total()
    number = total // 100
    rows = index.page(number, 100).select("o_orderkey", "o_custkey", "o_totalprice")
    w = Window.orderBy(F.desc("o_totalprice"), "o_orderkey")  # a page of 100 rows
    return rows.withColumn("place", F.row_number().over(w) - 1 + (number - 1) * 100).withColumn("total", F.lit(total)).drop("o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def album_projection(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 42")
def album_by_id(t):
    return t.orders.where(F.col("o_orderkey") == 42).select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus = 'O' AND l_quantity >= 30")
def visible_tracks(t):
    return _tracks(t).where((F.col("l_linestatus") == "O") & (F.col("l_quantity") >= 30)).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, l_orderkey IS NULL AS is_empty FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'A') ON l_orderkey = o_orderkey")
def empty_flag_projection(t):
    some = t.lineitem.where("l_returnflag = 'A'").select("l_orderkey").distinct()
    return t.orders.join(some, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.col("l_orderkey").isNull().alias("is_empty"))


@query("SELECT count(*) AS n FROM (SELECT nullif(l_returnflag, 'N') a, nullif(l_linestatus, 'F') b FROM lineitem) WHERE a IS NOT DISTINCT FROM b")
def null_safe_equal(t):
    return t.lineitem.select(F.nullif("l_returnflag", F.lit("N")).alias("a"), F.nullif("l_linestatus", F.lit("F")).alias("b")).where(F.col("a").eqNullSafe(F.col("b"))).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('O', 'P')")
def in_list(t):
    return t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_orderstatus").isin("O", "P")).select("o_orderkey")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%re%'")
def contains_search(t):
    return t.part.where(F.contains(names.ascii_lower(F.col("p_name")), F.lit("re"))).select("p_partkey", "p_name")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state FROM orders")
def case_when(t):
    s = F.col("o_orderstatus")
    return t.orders.select("o_orderkey", F.when(s == "F", "done").when(s == "O", "open").otherwise("other").alias("state"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_brand END, p_type) AS label FROM part")
def coalesced_label(t):
    return t.part.select("p_partkey", F.coalesce(F.when(F.col("p_size") > 25, F.col("p_brand")), "p_type").alias("label"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-08-02' - INTERVAL 900 DAY")
def played_retention(t):
    return t.orders.where(F.unix_millis("o_orderdate") < F.unix_millis(F.lit("1998-08-02").cast("timestamp")) - 900 * text.DAY_MS).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_totalprice < 100000 AND o_orderkey % 7 < 3)")
def pending_lookup(t):
    s = F.col("o_orderstatus")
    return t.orders.where((s == "P") | ((s == "O") & (F.col("o_totalprice") < 100000) & (F.col("o_orderkey") % 7 < 3))).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, round(least(1.0, greatest(0.0, l_quantity / nullif(l_extendedprice, 0) * 1000)), 6) AS progress FROM lineitem")
def progress_share(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(text.progress(F.col("l_quantity") * 1000, F.col("l_extendedprice")), 6).alias("progress"))


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R'")
def genre_link_join(t):
    return _tracks(t).join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")


@query("SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey = 3")
def artist_albums(t):
    return t.customer.where("c_nationkey = 3").join(t.orders, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "o_orderkey")


@query("SELECT p_partkey, n FROM part JOIN (SELECT p_type AS k, count(*) AS n FROM part GROUP BY 1) ON p_type = k")
def text_key_join(t):
    return t.part.join(t.part.groupBy(F.col("p_type").alias("k")).agg(F.count("*").alias("n")), F.col("p_type") == F.col("k")).select("p_partkey", "n")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 60 DAY")
def theta_filter_join(t):
    late = F.unix_millis("l_shipdate") > F.unix_millis("o_orderdate") + 60 * text.DAY_MS
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).where(late).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'")
def left_join_with_condition(t):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey")
    return t.customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("""SELECT o_orderkey, l_partkey AS first_part FROM orders LEFT JOIN (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) r FROM lineitem) ON l_orderkey = o_orderkey AND r = 1""")
def first_part_left_join(t):
    children = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_partkey").alias("first_part"))
    return relational.left_join_first(t.orders, children, "o_orderkey", ["l_linenumber", "first_part"]).select("o_orderkey", "first_part")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R')")
def albums_present_semi(t):
    return t.orders.join(_tracks(t), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_anti(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT event_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS found_id FROM events JOIN orders ON o_custkey = user_id AND o_orderdate <= ts GROUP BY 1
UNION ALL SELECT event_id, NULL FROM events WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = user_id AND o_orderdate <= ts)""")
def chapter_asof(t):
    points = t.events.select("event_id", "user_id", "ts")
    spans = t.orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("start"), F.col("o_orderkey").alias("id"))
    return relational.starting_at_or_before(points, spans, "user_id", "ts", "start", "id", ["id"]).select("event_id", "found_id")


@query("""WITH p AS (SELECT l_orderkey b, l_linenumber i, CAST(l_quantity AS BIGINT) d, l_partkey k FROM lineitem), s AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY b ORDER BY i, k, d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) st, row_number() OVER (PARTITION BY b ORDER BY i, k, d) - 1 AS pi FROM p),
q AS (SELECT o_orderkey b, CAST(o_orderkey % 150 AS BIGINT) x FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
f AS (SELECT q.b, q.x, min(pi) FILTER (WHERE x < st + d) hit, max(pi) lastp FROM q JOIN s ON s.b = q.b GROUP BY 1, 2)
SELECT f.b AS book_id, x, coalesce(hit, lastp) AS part_index, CAST(CASE WHEN hit IS NULL THEN d ELSE greatest(x - st, 0) END AS BIGINT) AS within_ms FROM f JOIN s ON s.b = f.b AND pi = coalesce(hit, lastp)""")
def offset_resolve(t):
    parts = t.lineitem.select(F.col("l_orderkey").alias("book_id"), "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("duration_ms"))
    order = ["l_linenumber", "l_partkey", "duration_ms"]
    placed = analytic.dense_positions(analytic.start_offsets(parts, "book_id", order, "duration_ms"), "book_id", order, "part_index").withColumn("part_index", F.col("part_index").cast("long"))
    points = t.orders.select(F.col("o_orderkey").alias("book_id"), (F.col("o_orderkey") % 150).alias("x"))
    return relational.resolve_offset(points, placed)


@query("SELECT pos, o_orderkey FROM (SELECT unnest([9, 3, 77777777, 5, 12]) AS id, unnest([0, 1, 2, 3, 4]) AS pos) JOIN orders ON o_orderkey = id")
def ids_in_order(t):
    ids = t.spark.range(1).select(F.posexplode(F.array(*[F.lit(x).cast("long") for x in (9, 3, 77777777, 5, 12)])).alias("pos", "o_orderkey"))
    return relational.in_input_order(ids, t.orders.select("o_orderkey"), "o_orderkey").select("pos", "o_orderkey")


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag <> 'R'")
def count_present(t):
    return _tracks(t).agg(F.count("*").alias("n"))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type")
def genre_counts(t):
    return t.part.groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1")
def tracks_per_album(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_albums FROM customer""")
def correlated_count(t):
    return relational.with_child_count(t.customer.select("c_custkey"), t.orders, "c_custkey", "o_custkey", "n_albums")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS missing, count(*) FILTER (WHERE l_discount = 0) AS no_discount, count(*) FILTER (WHERE l_tax > 0.05) AS taxed FROM lineitem")
def coverage_report(t):
    return t.lineitem.agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("missing"), F.count_if(F.col("l_discount") == 0).alias("no_discount"), F.count_if(F.col("l_tax") > 0.05).alias("taxed"))


@query("SELECT count(DISTINCT p_type) AS n FROM part")
def distinct_raw_count(t):
    return t.part.agg(F.count_distinct("p_type").alias("n"))


@query("SELECT DISTINCT p_type, p_brand FROM part")
def distinct_pairs(t):
    return t.part.select("p_type", "p_brand").distinct()


@query("SELECT p_brand, string_agg(p_type, chr(31) ORDER BY p_type) AS genres FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY 1")
def grouped_list(t):
    return t.part.select("p_brand", "p_type").distinct().groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("p_type")), "\x1f").alias("genres"))


@query("SELECT o_custkey, min(o_orderkey) AS first_id, max(o_orderdate) AS latest FROM orders GROUP BY 1")
def min_keeper_max_latest(t):
    return t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_id"), F.max("o_orderdate").cast("timestamp_ntz").alias("latest"))


@query("SELECT c_custkey, coalesce((SELECT max(turn) FROM conversations WHERE conv_id = c_custkey), -1) + 1 AS next_position FROM customer")
def next_position(t):
    top = t.conversations.groupBy(F.col("conv_id").alias("c_custkey")).agg(F.max("turn").alias("m"))
    return t.customer.join(top, "c_custkey", "left").select("c_custkey", (F.coalesce("m", F.lit(-1)) + 1).alias("next_position"))


@query("SELECT length(text) AS size, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def size_collision_having(t):
    return t.documents.groupBy(F.length("text").cast("long").alias("size")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT (SELECT count(*) FROM orders) AS albums, (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R') AS tracks, (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1) AS newest")
def library_totals(t):
    newest = t.orders.agg(F.count("*").alias("albums"), F.max_by("o_orderkey", F.struct("o_orderdate", -F.col("o_orderkey"))).alias("newest"))
    both = newest.unionByName(_tracks(t).agg(F.count("*").alias("tracks")), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("albums", "tracks", "newest")])


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, o_orderstatus) AS k FROM orders ORDER BY 2, 1 LIMIT 50")
def sort_by_computed_key(t):
    k = F.coalesce(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")), "o_orderstatus")
    return relational.page(t.orders.select("o_orderkey", k.alias("k")), ["k", "o_orderkey"], 1, 50)


@query("SELECT p_partkey, p_name FROM part ORDER BY lower(p_name) DESC, p_partkey LIMIT 40")
def sort_no_case(t):
    return t.part.select("p_partkey", "p_name").orderBy(relational.no_case(F.col("p_name")).desc(), "p_partkey").limit(40)


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY lower(p_name) DESC, p_partkey) AS r FROM part")
def sort_no_case_whole(t):
    keyed = t.part.select("p_partkey", "p_name", relational.no_case(F.col("p_name")).alias("k"))
    return ordering.numbered(keyed, [F.desc("k"), F.asc("p_partkey")], "r", 1).select("p_partkey", "p_name", "r")


@query("SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size END AS year FROM part ORDER BY year DESC NULLS LAST, p_partkey LIMIT 200")
def genre_tracks_page(t):
    year = F.when(F.col("p_size") > 10, F.col("p_size")).alias("year")
    return relational.page(t.part.select("p_partkey", year), [F.desc_nulls_last("year"), "p_partkey"], 1, 200)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 1000 ORDER BY 1 LIMIT 25")
def keyset_page(t):
    return relational.page_after(t.orders.select("o_orderkey"), "o_orderkey", 1000, 25)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("""SELECT s_suppkey, row_number() OVER (ORDER BY CASE WHEN s_nationkey % 4 = 0 THEN NULL ELSE upper(trim(s_name)) END NULLS LAST, s_acctbal DESC, s_suppkey) AS r FROM supplier""")
def station_sort(t):
    """Ranks by ranges of the order, not in one task; unknown codecs last."""
    from tonearm.operators.ordering import numbered

    codec = F.when(F.col("s_nationkey") % 4 != 0, F.upper(F.trim("s_name")))
    keyed = t.supplier.select("s_suppkey", codec.isNull().alias("unknown"), codec.alias("codec"), (-F.col("s_acctbal")).alias("least"))
    return numbered(keyed, ["unknown", "codec", "least", "s_suppkey"], "r", 1).select("s_suppkey", "r")


@query("SELECT c_custkey, row_number() OVER (ORDER BY CAST(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT), c_custkey) AS r FROM customer")
def natural_sort(t):
    keyed = t.customer.select("c_custkey", names.natural_key(F.col("c_name")).alias("k"))
    return ordering.numbered(keyed, [F.asc("k"), F.asc("c_custkey")], "r", 1).select("c_custkey", "r")
