"""Files, playlists, queues, matching, filters and jobs over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonearm.functions import names, text
from tonearm.operators import analytic, changes, entities, orderindex, relational, services
from tonearm.plans.registry import query
from tonearm.sources import feeds, playlists


def _nth(values: list, n):
    """The value at ``n`` modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def _sql_nth(values: list[str], n: str) -> str:
    listed = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[{n} % {len(values)} + 1]"


EXTENSIONS = ["mp3", "FLAC", "m4a", "MP4", "aac", "wave", "aif", "oga", "Opus", "dsf", "DFF", "iso", "txt", "jpg"]


@query(f"""SELECT c_custkey, CASE e WHEN 'mp4' THEN 'm4a' WHEN 'wave' THEN 'wav' WHEN 'aif' THEN 'aiff' WHEN 'oga' THEN 'ogg_vorbis' WHEN 'iso' THEN 'sacd_iso' ELSE e END AS format
FROM (SELECT c_custkey, lower({_sql_nth(EXTENSIONS, "c_custkey")}) AS e FROM customer) WHERE e NOT IN ('txt', 'jpg')""")
def audio_formats(t):
    path = F.concat(F.lit("/music.d/"), "c_name", F.lit("."), _nth(EXTENSIONS, F.col("c_custkey")))
    return t.customer.select("c_custkey", text.format_of(path).alias("format")).where("format IS NOT NULL")


@query("SELECT page_id, CAST(0 AS INT) AS pos, '/feeds/' || page_id || '?a=1&b=2' AS href, 'Feed ' || page_id AS title FROM pages WHERE html IS NOT NULL")
def feed_links_in_heads(t):
    link = F.concat(F.lit('<LINK title="Feed '), "page_id", F.lit("\" rel='alternate' type=\"application/rss+xml\" href=\"/feeds/"), "page_id", F.lit('?a=1&amp;b=2"><link rel="alternate" hreflang="de" href="/de">'), "html")
    return feeds.feed_links(t.pages.select("page_id", link.alias("html")), "page_id", "html")


@query("""SELECT o_custkey AS feed_id, 'g' || o_orderkey AS guid, 'T & ' || o_orderpriority AS title, 'https://x.example/' || o_orderkey || '.mp3?a=1&b=2' AS enclosure_url, 'audio/mpeg' AS mime,
CAST((o_orderkey + 1) * 1000 AS BIGINT) AS duration_ms, epoch_ms(o_orderdate) AS published_at FROM orders WHERE o_orderstatus <> 'F'""")
def feed_episodes(t):
    """Items with bare ampersands, character data, a repeated guid, video, and a text that is cut off."""
    kind = F.when(F.col("o_orderstatus") == "F", F.lit("video/mp4")).otherwise(F.lit("Audio/MPEG"))
    when = F.date_format("o_orderdate", "d MMM yyyy HH:mm:ss")
    item = F.concat(
        F.lit("<item><title>T & "), "o_orderpriority", F.lit("</title><guid isPermaLink='false'><![CDATA[g"), "o_orderkey", F.lit("]]></guid><pubDate>Xyz, "), when, F.lit(" +0000</pubDate><itunes:duration>"), F.col("o_orderkey") + 1,
        F.lit('</itunes:duration><enclosure length="1" url="https://x.example/'), "o_orderkey", F.lit('.mp3?a=1&b=2" type="'), kind, F.lit('"/></item>'),
    )
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("i")))), lambda x: x["i"]), "\n")
    body = t.orders.groupBy(F.col("o_custkey").alias("feed_id")).agg(listed.alias("b"))
    whole = body.select("feed_id", F.concat(F.lit("<rss><channel><title>x</title>"), "b", "b", F.lit("<item><title>cut off")).alias("text"))
    return feeds.feed_items(whole).drop("pos")


@query("SELECT p_partkey, p_name || ' – é' AS content FROM part")
def decoded_texts(t):
    s = F.concat("p_name", F.lit(" – é"))
    latin = F.concat(F.encode("p_name", "ISO-8859-1"), F.unhex(F.lit("209620E9")))
    raw = F.when(F.col("p_partkey") % 3 == 0, F.encode(s, "UTF-8")).when(F.col("p_partkey") % 3 == 1, F.encode(s, "UTF-16")).otherwise(latin)
    return t.part.select("p_partkey", feeds.decoded(raw).alias("content"))


@query("SELECT 's' || s_nationkey AS name, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT) AS pos, 'https://x.example/?a=' || s_suppkey || '&b=\"' AS url, 'T <' || s_name || '>' AS title FROM supplier")
def subscription_lists(t):
    rows = analytic.dense_positions(t.supplier, "s_nationkey", ["s_suppkey"], "pos")
    made = rows.select(F.concat(F.lit("s"), "s_nationkey").alias("name"), "pos", F.concat(F.lit("https://x.example/?a="), "s_suppkey", F.lit('&b="')).alias("url"), F.concat(F.lit("T <"), "s_name", F.lit(">")).alias("title"))
    return feeds.opml_feeds(feeds.to_opml(made)).withColumn("pos", F.col("pos").cast("int"))


@query("""SELECT k AS uuid, s_name AS name, 'http://x.example/' || s_suppkey AS url, CASE WHEN s_suppkey % 2 = 0 THEN 'MP3' END AS codec, CASE WHEN s_nationkey > 5 THEN CAST(s_nationkey AS BIGINT) END AS bitrate
FROM (SELECT CAST(s_suppkey AS VARCHAR) AS k, * FROM supplier) WHERE s_suppkey % 7 <> 3""")
def station_directory(t):
    """Numbers as text, a fallback address, blank codecs, bitrates that aren't positive, rows without an address."""
    k = F.col("s_suppkey")
    a = F.concat(F.lit("http://x.example/"), k)
    row = F.struct(
        k.cast("string").alias("stationuuid"), F.concat(F.lit(" "), "s_name").alias("name"), F.when(k % 7 == 3, F.lit("")).otherwise(a).alias("url"), F.when((k % 7 != 3) & (k % 2 == 0), a).otherwise(F.lit(" ")).alias("url_resolved"),
        F.when(k % 2 == 0, F.lit("MP3")).otherwise(F.lit("")).alias("codec"), F.greatest(F.col("s_nationkey") * F.when(F.col("s_nationkey") > 5, 1).otherwise(-1), F.lit(-3)).cast("string").alias("bitrate"),
    )
    return feeds.stations(t.supplier.groupBy("s_nationkey").agg(F.to_json(F.collect_list(row)).alias("body")))


@query("SELECT n_nationkey AS query_id, CAST(r AS INT) AS pos, 'id' || (n_nationkey + r) AS mbid, n_name AS title, 'A, B' AS artist, CAST(n_regionkey AS INT) AS track_count, CAST(CASE WHEN r = 0 THEN 90 ELSE 0 END AS INT) AS score, CAST(1990 + n_regionkey AS INT) AS year FROM nation, (VALUES (0), (1)) v(r)")
def release_lookup(t):
    one = lambda r: F.concat(F.lit('{"id":"id'), F.col("n_nationkey") + r, F.lit('","title":"'), "n_name", F.lit('","artist-credit":[{"name":"A"},{"name":"B"}],"track-count":"'), "n_regionkey", F.lit('","date":"'), F.col("n_regionkey") + 1990, F.lit('-05-01"' + (',"score":90' if r == 0 else "") + "}"))
    body = F.concat(F.lit('{"releases":['), one(0), F.lit(","), one(1), F.lit(',{"title":"no id"}]}'))
    return feeds.releases(t.nation.select(F.col("n_nationkey").alias("query_id"), body.alias("body")))


@query("SELECT n_nationkey AS query_id, CAST(0 AS INT) AS pos, 'k' || n_nationkey AS \"key\", n_name AS title, [n_name || ' x', 'Y'] AS authors, CAST(CASE WHEN n_regionkey > 0 THEN 1900 + n_regionkey END AS INT) AS year, CAST(NULL AS BIGINT) AS cover FROM nation")
def book_lookup(t):
    year = F.when(F.col("n_regionkey") > 0, F.concat(F.lit(',"first_publish_year":'), F.col("n_regionkey") + 1900)).otherwise("")
    body = F.concat(F.lit('{"docs":[{"key":"k'), "n_nationkey", F.lit('","title":"'), "n_name", F.lit('","author_name":["'), "n_name", F.lit(' x","Y"]'), year, F.lit('},{"key":"none"}]}'))
    return feeds.books(t.nation.select(F.col("n_nationkey").alias("query_id"), body.alias("body")))


@query("""SELECT 'p' || p_partkey AS name, CAST(-1 AS INT) AS pos, 'preamp' AS kind, CAST(NULL AS DOUBLE) AS freq, -p_size / 10 AS gain_db, CAST(NULL AS DOUBLE) AS q FROM part
UNION ALL SELECT 'p' || p_partkey, 1, 'peaking', 100.0 + p_size, p_size / 10, 1.41 FROM part UNION ALL SELECT 'p' || p_partkey, 3, 'high_shelf', 8000.0, 0.0, 0.707 FROM part""")
def equaliser_texts(t):
    size = F.col("p_size")
    tenth = F.concat(F.floor(size / 10), F.lit("."), size % 10)
    body = F.concat(F.lit("Preamp: -"), tenth, F.lit(" dB\nFilter 1: ON PK Fc "), size + 100, F.lit(" Hz Gain "), tenth, F.lit(" dB Q 1.41\nFilter 2: OFF PK Fc 50 Hz Gain 1 dB Q 1\r\nfilter 3: on HSC Fc 8000 Hz\n"))
    return feeds.eq_profile(t.part.select(F.concat(F.lit("p"), "p_partkey").alias("name"), body.alias("text"))).withColumn("pos", F.col("pos").cast("int"))


@query("SELECT 'c' || conv_id AS name, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, 'a/' || turn || '.mp3' AS raw, CASE WHEN turn % 2 = 0 THEN role END AS title FROM conversations")
def m3u_read(t):
    line = F.concat(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("#EXTINF:12, "), "role", F.lit("\r\n"))).otherwise(F.lit("#EXTGRP:x\n")), F.lit("\n  a/"), "turn", F.lit(".mp3"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n")
    return playlists.m3u_entries(t.conversations.groupBy(F.concat(F.lit("c"), "conv_id").alias("name")).agg(F.concat(F.lit("#EXTM3U\n"), joined).alias("text")))


def _entries(t):
    """Playlists of orders, one per customer, with blank and multi-line tags and odd lengths."""
    rows = analytic.dense_positions(t.orders, "o_custkey", ["o_orderkey"], "pos")
    k = F.col("o_orderkey")
    title = F.when(k % 6 == 0, F.lit(None)).when(k % 6 == 1, " \n\t").when(k % 6 == 2, F.concat(F.lit(" A\t"), "o_orderpriority", F.lit("\r\nx\x07 "))).otherwise(F.concat("o_orderpriority", F.lit(" <&> 'q'")))
    length = F.when(k % 4 == 0, F.lit(None)).when(k % 7 == 0, k % 500).when(k % 9 == 0, 0).otherwise(k * 1000 + k % 1000)
    return rows.select(
        F.concat(F.lit("c & "), "o_custkey").alias("name"), "pos", F.concat(F.lit("/m/a b/"), k, F.lit(".x.mp3")).alias("path"), title.alias("title"), F.when(k % 3 > 0, F.concat(F.lit("\n"), "o_orderstatus")).otherwise(" ").alias("artist"),
        F.when(k % 5 > 2, F.concat(F.lit("On\x01"), "o_custkey")).alias("album"), length.alias("duration_ms"), F.when(k % 8 == 1, F.concat(F.lit("http://i/?a&"), k)).alias("image"), (F.col("o_orderstatus") == "F").alias("missing"), (k % 5 > 0).alias("decodable"),
    )


_RAW = """SELECT o_custkey, 'c & ' || o_custkey AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderkey AS k, o_orderstatus, CASE WHEN o_orderkey % 3 > 0 THEN chr(10) || o_orderstatus ELSE ' ' END AS rawartist,
CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN ' ' || chr(10) || chr(9) WHEN 2 THEN ' A' || chr(9) || o_orderpriority || chr(13) || chr(10) || 'x' || chr(7) || ' ' ELSE o_orderpriority || ' <&> ''q''' END AS rawtitle,
CASE WHEN o_orderkey % 5 > 2 THEN 'On' || chr(1) || o_custkey END AS rawalbum, CASE WHEN o_orderkey % 8 = 1 THEN 'http://i/?a&' || o_orderkey END AS image,
CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN o_orderkey % 500 WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_orderkey * 1000 + o_orderkey % 1000 END AS ms FROM orders"""
_TAG = "nullif(trim(regexp_replace({}, '[\\x00-\\x1f\\x7f-\\x9f]', ' ', 'g')), '')"
_POS = f"""SELECT *, CASE WHEN ms IS NULL OR ms <= 0 THEN -1 WHEN ms < 1500 THEN 1 ELSE (ms + 500) // 1000 END AS secs, coalesce(artist || ' - ', '') || title AS shown
FROM (SELECT *, coalesce({_TAG.format("rawtitle")}, k || '.x') AS title, {_TAG.format("rawartist")} AS artist, {_TAG.format("rawalbum")} AS album FROM ({_RAW}))"""
_XML = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(39), '&apos;')"


@query(f"SELECT name, '#EXTM3U' || chr(10) || string_agg('#EXTINF:' || secs || ',' || shown || chr(10) || '/m/a b/' || k || '.x.mp3' || chr(10), '' ORDER BY pos) AS text FROM ({_POS}) GROUP BY name")
def m3u_written(t):
    return playlists.to_m3u(_entries(t))


@query(f"""SELECT name, '[playlist]' || chr(10) || string_agg('File' || (pos + 1) || '=/m/a b/' || k || '.x.mp3' || chr(10) || 'Title' || (pos + 1) || '=' || shown || chr(10) || 'Length' || (pos + 1) || '=' || secs || chr(10), '' ORDER BY pos)
|| 'NumberOfEntries=' || count(*) || chr(10) || 'Version=2' || chr(10) AS text FROM ({_POS}) GROUP BY name""")
def pls_written(t):
    return playlists.to_pls(_entries(t))


@query(f"""SELECT name, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<playlist version="1" xmlns="http://xspf.org/ns/0/">' || chr(10) || '  <title>' || {_XML.format("name")} || '</title>' || chr(10) || '  <trackList>' || chr(10)
|| string_agg('    <track>' || chr(10) || '      <location>file:///m/a%20b/' || k || '.x.mp3</location>' || chr(10) || '      <title>' || {_XML.format("title")} || '</title>' || chr(10) || coalesce('      <creator>' || {_XML.format("artist")} || '</creator>' || chr(10), '')
|| coalesce('      <album>' || {_XML.format("album")} || '</album>' || chr(10), '') || CASE WHEN ms > 0 THEN '      <duration>' || ms || '</duration>' || chr(10) ELSE '' END || coalesce('      <image>' || {_XML.format("image")} || '</image>' || chr(10), '') || '    </track>' || chr(10), '' ORDER BY pos)
|| '  </trackList>' || chr(10) || '</playlist>' || chr(10) AS text FROM ({_POS}) GROUP BY name""")
def xspf_written(t):
    return playlists.to_xspf(_entries(t))


@query(f"SELECT name, count(*) FILTER (o_orderstatus = 'F' OR k % 5 = 0) AS skipped, count(*) FILTER (o_orderstatus <> 'F' AND k % 5 > 0) AS kept FROM ({_POS}) GROUP BY name")
def playlist_export_counts(t):
    kept, skipped = playlists.exported(_entries(t))
    return relational.with_child_count(skipped, kept, "name", "name", "kept")


@query("SELECT event_id AS \"key\", CASE WHEN value > 100 THEN props END AS body, coalesce(value > 100 AND epoch_ms(ts) >= 1704240000000 - 86400000, false) AS fresh FROM events")
def response_cache(t):
    cache = t.events.where("value > 100").select(F.col("event_id").alias("key"), F.col("props").alias("body"), F.unix_millis("ts").alias("fetched_at"))
    return changes.cached_lookup(t.events.select(F.col("event_id").alias("key")), cache, 1704240000000).select("key", "body", "fresh")


@query("SELECT page_id FROM pages WHERE lower(url) LIKE '%utm\\_source=fe%' ESCAPE '\\' AND page_id > 3")
def filters_if_given(t):
    """Filters whose value is not given let all rows pass; wildcards in a search stand for themselves."""
    given = [("UTM_source=fe", relational.contains_text(F.col("url"), "UTM_source=fe")), ("", relational.contains_text(F.col("url"), "%")), (0, F.col("page_id") == 0), (3, F.col("page_id") > 3), (None, F.lit(False))]
    return relational.filtered(t.pages, given).select("page_id")


@query("SELECT c_custkey FROM customer")
def all_rows_page(t):
    return relational.page(t.customer, ["c_custkey"], 3, -1).select("c_custkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500 OFFSET 500")
def clamped_page(t):
    return orderindex.ordered(t.orders.select("o_orderdate", "o_orderkey"), [(F.col("o_orderdate"), True), (F.col("o_orderkey"), True)]).page(2, 9999).select("o_orderkey")


def _imports(t):
    k = F.col("p_partkey")
    file = F.concat(k, F.lit(".mp3"))
    raw = F.when(k % 4 == 0, F.concat(F.lit("/lib/b/"), file)).when(k % 4 == 1, F.concat(F.lit("./"), file)).when(k % 4 == 2, file).otherwise(F.concat(F.lit("gone/"), k))
    tracks = t.part.select((k * 2).alias("track_id"), F.concat(F.lit("/lib/b/"), file).alias("path")).unionByName(t.part.where("p_size % 2 = 0").select((k * 2 + 1).alias("track_id"), F.concat(F.lit("/lib/a/"), file).alias("path")))
    return t.part.select(k.alias("pos"), raw.alias("raw")), tracks


_MATCHED = """WITH e AS (SELECT p_partkey AS pos, p_partkey % 4 AS m, p_size % 2 = 0 AS a FROM part) SELECT pos, CASE m WHEN 0 THEN '/lib/b/' || pos || '.mp3' WHEN 1 THEN './' || pos || '.mp3' WHEN 2 THEN pos || '.mp3' ELSE 'gone/' || pos END AS raw,
CASE WHEN m = 0 THEN pos * 2 WHEN m = 3 THEN NULL WHEN a THEN pos * 2 + 1 ELSE pos * 2 END AS track_id FROM e"""


@query(_MATCHED)
def playlist_paths(t):
    entries, tracks = _imports(t)
    return relational.best_path_match(entries, ["/lib/a/", "/lib/b"], tracks)


@query(f"SELECT row_number() OVER (ORDER BY pos) - 1 AS position, track_id, CAST(NULL AS VARCHAR) AS unmatched FROM ({_MATCHED}) WHERE track_id IS NOT NULL UNION ALL SELECT NULL, NULL, raw FROM ({_MATCHED}) WHERE track_id IS NULL")
def playlist_imported(t):
    entries, tracks = _imports(t)
    matched, rest = entities.playlist_import(entries, ["/lib/a/", "/lib/b"], tracks)
    none = F.lit(None).cast("long")
    return matched.select("position", "track_id", F.lit(None).cast("string").alias("unmatched")).unionByName(rest.select(none.alias("position"), none.alias("track_id"), F.col("raw").alias("unmatched")))


@query("""SELECT playlist_id, row_number() OVER (PARTITION BY playlist_id ORDER BY s, o) - 1 AS position, track_id FROM
(SELECT conv_id AS playlist_id, 0 AS s, turn AS o, turn + 100 AS track_id FROM conversations UNION ALL SELECT conv_id, 1, -turn, turn FROM conversations WHERE role = 'user')""")
def playlist_appended(t):
    c = t.conversations
    items = c.where("role = 'user'").select(F.col("conv_id").alias("playlist_id"), (-F.col("turn")).alias("ord"), F.col("turn").alias("track_id"))
    return entities.appended(_queue(c).withColumnRenamed("queue_id", "playlist_id"), items).withColumn("position", F.col("position").cast("long"))


def _queue(c):
    return analytic.dense_positions(c.select(F.col("conv_id").alias("queue_id"), "turn"), "queue_id", ["turn"]).select("queue_id", "position", (F.col("turn") + 100).alias("track_id"))


_QUEUE = "(SELECT conv_id AS queue_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, turn + 100 AS track_id FROM conversations)"


@query(f"""SELECT queue_id, row_number() OVER (PARTITION BY queue_id ORDER BY g, p) - 1 AS position, track_id FROM
(SELECT queue_id, CASE WHEN p < 1 THEN 0 ELSE 2 END AS g, p, track_id FROM {_QUEUE} UNION ALL SELECT queue_id, 1, p, track_id + 1000 FROM {_QUEUE} WHERE p < 2)""")
def queue_inserted(t):
    q = _queue(t.conversations)
    items = q.where("position < 2").select("queue_id", F.col("position").alias("ord"), (F.col("track_id") + 1000).alias("track_id"))
    return entities.queue_inserted(q, items, 1).select("queue_id", F.col("position").cast("long"), "track_id")


@query(f"SELECT queue_id, row_number() OVER (PARTITION BY queue_id ORDER BY CASE WHEN p = 0 THEN 1.5 ELSE p END) - 1 AS position, track_id FROM {_QUEUE}")
def queue_moved(t):
    return entities.queue_moved(_queue(t.conversations), 0, 1).select("queue_id", F.col("position").cast("long"), "track_id")


@query(f"SELECT queue_id, row_number() OVER (PARTITION BY queue_id ORDER BY p) - 1 AS position, track_id FROM {_QUEUE} WHERE p <> 1")
def queue_removed(t):
    return entities.queue_removed(_queue(t.conversations), 1).select("queue_id", F.col("position").cast("long"), "track_id")


@query("SELECT user_id, max(abs(value) * pow(0.5, n - r)) AS peak FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY 1")
def peak_held(t):
    return analytic.peak_hold(t.events, "user_id", "event_id", "value", 0.5)


@query("""WITH p AS (SELECT o_custkey AS book_id, 'p' || o_orderkey AS path, o_orderkey AS k, CASE WHEN o_custkey % 2 = 0 OR o_orderkey % 3 > 0 THEN o_orderkey % 7 END AS track FROM orders),
q AS (SELECT *, count(*) OVER (PARTITION BY book_id) = count(track) OVER (PARTITION BY book_id) AS tagged FROM p)
SELECT book_id, path, row_number() OVER (PARTITION BY book_id ORDER BY CASE WHEN tagged THEN track ELSE k END, path) - 1 AS part_index FROM q""")
def parts_in_order(t):
    k = F.col("o_orderkey")
    track = F.when((F.col("o_custkey") % 2 == 0) | (k % 3 > 0), (k % 7).cast("int"))
    parts = t.orders.select(F.col("o_custkey").alias("book_id"), F.concat(F.lit("p"), k).alias("path"), F.lit(None).cast("int").alias("disc"), track.alias("track"))
    return relational.disc_track_or_natural(parts).select("book_id", "path", F.col("part_index").cast("long"))


@query("SELECT DISTINCT p_partkey AS id, g.genre FROM part JOIN (VALUES ('ECONOMY', 'Cheap'), ('ECONOMY', 'Plain'), ('STANDARD', 'Plain'), ('PROMO', 'Loud')) g(raw, genre) ON g.raw = p_type WHERE p_size % 5 <> 0 AND p_size % 7 <> 0")
def genre_links_inserted(t):
    mapped = t.spark.createDataFrame([("ECONOMY", "Cheap"), ("ECONOMY", "Plain"), ("STANDARD", "Plain"), ("PROMO", "Loud")], "raw string, genre string")
    tracks = t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("raw"), (F.col("p_size") % 5 == 0).alias("missing"), F.when(F.col("p_size") % 7 == 0, F.col("p_partkey")).alias("duplicate_of"))
    return entities.track_genres(tracks, mapped)


@query("SELECT l_orderkey AS book_id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 5 = 2) GROUP BY 1")
def root_deleted(t):
    books = t.orders.select(F.col("o_orderkey").alias("book_id"), (F.col("o_custkey") % 5).alias("root_id"))
    _, (parts,) = services.without_root(books, [t.lineitem.select(F.col("l_orderkey").alias("book_id"))], 2)
    return parts.groupBy("book_id").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT 'f' || o_orderkey AS path, o_orderkey % 50 AS folder, o_orderkey % 40 AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'c' || (o_custkey % 20) END AS aa, 'c' || (o_custkey % 30) AS ta FROM orders),
a AS (SELECT c_custkey AS id, c_custkey % 40 AS title, CASE WHEN c_custkey % 11 = 0 THEN 'various artists' ELSE 'c' || (c_custkey % 20) END AS artist, c_custkey % 50 AS folder FROM customer),
m AS (SELECT path, id, CASE WHEN aa = artist THEN 1 WHEN aa IS NULL AND f.folder = a.folder THEN 2 WHEN aa IS NULL AND ta = artist THEN 3 WHEN aa IS NULL AND artist = 'various artists' THEN 4 END AS r FROM f JOIN a USING (title)),
b AS (SELECT path, arg_min(id, CAST(r AS BIGINT) * 1000000000 + id) AS album_id, min(r) AS r FROM m WHERE r IS NOT NULL GROUP BY 1)
SELECT path, album_id, CASE r WHEN 1 THEN 'album_artist' WHEN 2 THEN 'folder' WHEN 3 THEN 'artist' WHEN 4 THEN 'various' ELSE 'new' END AS rule FROM f LEFT JOIN b USING (path)""")
def album_resolution(t):
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    artist = lambda x: F.concat(F.lit("c"), x)
    files = t.orders.select(F.concat(F.lit("f"), k).alias("path"), (k % 50).alias("folder"), (k % 40).alias("title_key"), F.when(k % 3 == 0, artist(F.col("o_custkey") % 20)).alias("album_artist_key"), artist(F.col("o_custkey") % 30).alias("artist_key"))
    albums = t.customer.select(c.alias("id"), (c % 40).alias("title_key"), F.when(c % 11 == 0, F.lit("various artists")).otherwise(artist(c % 20)).alias("artist_key"), (c % 50).alias("folder"))
    return entities.resolved_album(files, albums)


@query("""WITH s AS (SELECT c_custkey AS k, min(c_custkey) OVER (PARTITION BY c_nationkey, c_custkey % 3) AS id, CASE WHEN c_custkey % 4 > 1 THEN c_custkey % 90 END AS year, CASE WHEN c_custkey % 5 > 0 THEN CASE WHEN c_nationkey % 2 = 0 THEN ' a  B' ELSE c_mktsegment END END AS artist FROM customer)
SELECT id, arg_min(year, k) FILTER (year IS NOT NULL) AS year, CASE WHEN count(DISTINCT lower(trim(replace(artist, '  ', ' ')))) > 1 THEN 'Various Artists' ELSE arg_min(artist, k) FILTER (artist IS NOT NULL) END AS artist FROM s GROUP BY id""")
def merged_albums(t):
    from pyspark.sql import Window

    k, n = F.col("c_custkey"), F.col("c_nationkey")
    artist = F.when(k % 5 > 0, F.when(n % 2 == 0, F.lit(" a  B")).otherwise(F.col("c_mktsegment")))
    albums = t.customer.select(k.alias("id"), F.when(k % 4 > 1, k % 90).alias("year"), artist.alias("artist"))
    survivors = t.customer.select(k.alias("album_id"), F.min("c_custkey").over(Window.partitionBy("c_nationkey", k % 3)).alias("survivor"))
    return entities.merged_fields(albums, survivors, ["year"])


_SIM = "CAST(CAST(CASE WHEN {0} = {1} OR greatest(length({0}), length({1})) = 0 THEN 1 ELSE CAST(1 AS DOUBLE) - CAST(levenshtein({0}, {1}) AS DOUBLE) / greatest(length({0}), length({1})) END AS FLOAT) AS DOUBLE)"
_NEXT = "(SELECT a.*, b.p_name AS n_name, b.p_brand AS n_brand, b.p_size AS n_size, b.p_type AS n_type FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"


def _with_next(t):
    n = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("n_name"), F.col("p_brand").alias("n_brand"), F.col("p_size").alias("n_size"), F.col("p_type").alias("n_type"))
    return t.part.join(n, "p_partkey")


@query(f"""SELECT p_partkey, CAST(CAST(CAST(0.35 AS DOUBLE) * t + CAST(0.25 AS DOUBLE) * a + CAST(0.25 AS DOUBLE) * n + CAST(0.15 AS DOUBLE) * (p_size * 2 / CAST(100 AS DOUBLE)) AS FLOAT) AS DOUBLE) AS confidence FROM (SELECT p_partkey, p_size, {_SIM.format("lower(p_name)", "lower(n_name)")} AS t,
CASE WHEN p_size % 4 > 0 THEN {_SIM.format("lower(p_brand)", "lower(n_brand)")} ELSE 0.5 END AS a, CASE WHEN p_size % 3 > 0 AND n_size > 0 THEN least(p_size, n_size) / greatest(p_size, n_size) ELSE 0.5 END AS n FROM {_NEXT})""")
def release_matching(t):
    size = F.col("p_size")
    artist, count = F.when(size % 4 > 0, F.col("p_brand")), F.when(size % 3 > 0, size).otherwise(0)
    c = entities.release_confidence(F.col("p_name"), artist, count, F.col("n_name"), F.col("n_brand"), F.col("n_size"), size * 2)
    return _with_next(t).select("p_partkey", c.cast("double").alias("confidence"))


@query(f"""WITH x AS (SELECT p_partkey, {_SIM.format("p_name", "n_name")} AS t, {_SIM.format("lower(p_brand)", "lower(n_brand)")} AS a, CASE WHEN list_contains(string_split(p_type || ' x', ' '), lower(p_brand)) THEN 1.0 ELSE 0.0 END AS w, p_size FROM {_NEXT}),
y AS (SELECT p_partkey, CAST(CAST(t * CASE WHEN p_size % 3 > 0 THEN CAST(0.4 AS DOUBLE) + CAST(0.6 AS DOUBLE) * greatest(a, w) ELSE CAST(0.9 AS DOUBLE) END AS FLOAT) AS DOUBLE) AS confidence FROM x) SELECT * FROM y WHERE confidence >= 0.5""")
def book_matching(t):
    """The surest candidate at 0.5 or more; subtitles don't count, an unknown author costs a tenth."""
    pairs = _with_next(t).withColumn("author", F.when(F.col("p_size") % 3 > 0, F.col("p_brand"))).withColumn("pos", F.lit(0))
    c = entities.book_confidence(F.concat("p_name", F.lit(": a tale")), F.col("author"), F.concat("n_name", F.lit(" (2nd)")), F.array("n_brand"))
    return entities.best_match(pairs, "p_partkey", c.cast("double"), "pos", 0.5).select("p_partkey", "confidence")


@query(f"""WITH a AS (SELECT DISTINCT p_name AS n, CASE WHEN p_size % 3 > 0 THEN p_brand END AS w FROM part), b AS (SELECT p_name AS n, p_brand AS w, max(p_partkey) AS pos FROM part GROUP BY 1, 2),
c AS (SELECT a.n, a.w, b.pos, CAST(CAST(t * CASE WHEN a.w IS NULL THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) + CAST(0.6 AS DOUBLE) * s END AS FLOAT) AS DOUBLE) AS confidence FROM (SELECT a.n, a.w, b.pos, {_SIM.format("a.n", "b.n")} AS t, {_SIM.format("lower(a.w)", "lower(b.w)")} AS s FROM a, b) x JOIN a ON a.n = x.n AND a.w IS NOT DISTINCT FROM x.w JOIN b ON b.pos = x.pos),
m AS (SELECT n, w, max_by(pos, (confidence, pos)) AS position, max(confidence) AS confidence FROM c WHERE confidence >= 0.8 GROUP BY 1, 2) SELECT p_partkey AS book_id, position, confidence FROM part JOIN m ON n = p_name AND w IS NOT DISTINCT FROM CASE WHEN p_size % 3 > 0 THEN p_brand END""")
def books_matched_whole(t):
    """Every book against the whole catalogue, through the index of title segments."""
    author = F.when(F.col("p_size") % 3 > 0, F.col("p_brand"))
    books = t.part.select(F.col("p_partkey").alias("book_id"), F.concat("p_name", F.lit(": a tale")).alias("title"), author.alias("author"))
    offered = t.part.select(F.col("p_partkey").alias("position"), F.concat(F.initcap("p_name"), F.lit(" (2nd)")).alias("title"), F.array("p_brand").alias("authors"))
    return entities.matched_books(books, offered).withColumn("confidence", F.col("confidence").cast("double"))


@query(f"SELECT p_partkey, round(CAST(CAST(len([w for w in string_split(p_name, ' ') if list_contains(string_split(n_name, ' '), w)]) AS DOUBLE) / len(string_split(p_name, ' ')) AS DOUBLE), 4) AS share FROM {_NEXT}")
def shared_words(t):
    return _with_next(t).select("p_partkey", F.round(names.word_overlap(F.concat(F.lit(" "), "p_name"), F.col("n_name")).cast("double"), 4).alias("share"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Ann ' || p_type END AS narrator, CASE WHEN p_size % 3 > 0 THEN CAST(p_size + 0.5 AS DOUBLE) END AS series_index, CASE WHEN p_size % 5 > 0 THEN CAST(1950 + p_size AS INT) END AS year, p_name AS title,
CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS author, CASE WHEN p_partkey % 3 > 1 THEN p_type END AS series FROM part""")
def book_folders(t):
    size, k = F.col("p_size"), F.col("p_partkey")
    last = F.concat(
        F.when(size % 3 > 0, F.concat(_nth(["Vol. ", "Book ", "#", "volume "], size), size, F.lit(".5 - "))).otherwise(""), F.when(size % 5 > 0, F.concat(size + 1950, F.lit(" - "))).otherwise(""), F.col("p_name"),
        F.when(size % 2 == 0, F.concat(F.lit(" {Ann "), "p_type", F.lit("}"))).otherwise(""),
    )
    parts = F.when(k % 3 == 0, F.array(last)).when(k % 3 == 1, F.array("p_brand", last)).otherwise(F.array("p_brand", "p_type", last))
    return t.part.withColumn("parts", parts).select("p_partkey", names.parse_folder(F.col("parts")).alias("b")).select("p_partkey", "b.*")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_name || ' by ' || CASE WHEN p_size % 3 = 1 THEN 'Ann Mc' || p_type || ': Bo' ELSE 'the sea' END END AS title,
CASE WHEN p_size % 3 = 0 THEN 'Ann Mc' || p_type || ', Bo Li' WHEN p_partkey % 2 = 0 THEN p_brand END AS author FROM part""")
def authors_untangled(t):
    """An author in the title is taken out where the end looks like names and the tag has no author of its own."""
    size = F.col("p_size")
    end = F.when(size % 3 == 0, F.concat(F.lit("Ann Mc"), "p_type", F.lit(", Bo Li"))).when(size % 3 == 1, F.concat(F.lit("Ann Mc"), "p_type", F.lit(": Bo"))).otherwise(F.lit("the sea"))
    title = F.concat("p_name", F.lit(" by "), end)
    author = F.when(size % 3 == 0, F.when(F.col("p_partkey") % 2 == 0, F.upper(title))).when(F.col("p_partkey") % 2 == 0, F.col("p_brand"))
    made = t.part.withColumn("title", title).withColumn("author", author)
    return made.select("p_partkey", names.untangle_author(F.col("title"), F.col("author")).alias("b")).select("p_partkey", "b.*")


DISCS = ["CD 1", "Disc_02", "disk-3", "Side A", "CDs", "cd10 "]


@query(f"SELECT c_custkey, ([1, 2, 3, NULL, NULL, 10])[c_custkey % 6 + 1] AS disc, '/b/' || c_name || CASE WHEN c_custkey % 6 IN (3, 4) THEN '/' || {_sql_nth(DISCS, 'c_custkey')} ELSE '' END AS book FROM customer")
def disc_folders(t):
    folder = _nth(DISCS, F.col("c_custkey"))
    return t.customer.select("c_custkey", names.disc_number(folder).alias("disc"), names.book_dir(F.concat(F.lit("/b/"), "c_name", F.lit("/"), folder, F.lit("/01.mp3"))).alias("book"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_brand ELSE p_name || ' - x' END AS field FROM part")
def fields_merged(t):
    k = F.col("p_partkey")
    tag = F.when(k % 4 == 0, F.concat(F.lit(" --"), "p_name", F.lit("_ "))).when(k % 4 == 1, F.lit(" -_ ")).when(k % 4 == 3, F.concat("p_name", F.lit(" - x")))
    return t.part.select("p_partkey", names.merge_field(tag, F.col("p_brand")).alias("field"))


@query("SELECT p_partkey, 'b=' || replace(p_brand, '#', '%23') || '&q=' || replace(p_name, ' ', '%20') || '&z=%2A~' AS \"key\" FROM part")
def request_keys(t):
    return t.part.select("p_partkey", text.canonical_query(F.create_map(F.lit("z"), F.lit("*~"), F.lit("q"), "p_name", F.lit("b"), "p_brand")).alias("key"))


@query("SELECT page_id, url AS back, replace(url, '&', '&amp;') || '&amp;&lt;' AS repaired FROM pages")
def xml_repaired(t):
    bad = F.concat(F.replace(F.col("url"), F.lit("&"), F.lit("&\x01")), F.lit("&&lt;"))
    return t.pages.select("page_id", text.xml_unescape(text.xml_escape(F.col("url"))).alias("back"), text.repaired_xml(bad).alias("repaired"))


MIMES = ["audio/mpeg", "AUDIO/X-M4A", None, "audio/aac", "application/ogg", "audio/flac", "text/html", ""]
ADDRESSES = ["x.opus", "x.wav?y=.mp3", "x.php"]


@query(f"SELECT c_custkey, coalesce(([ 'mp3', 'm4a', NULL, 'aac', 'ogg', 'flac', NULL, NULL])[c_custkey % 8 + 1], (['opus', 'wav', 'mp3'])[c_custkey % 3 + 1]) AS extension, (['MP3', 'AAC', NULL, 'AAC', 'OGG', 'FLAC', NULL, NULL])[c_custkey % 8 + 1] AS codec, c_custkey % 3 = 1 AS he_aac FROM customer")
def media_types(t):
    k = F.col("c_custkey")
    mime = _nth(MIMES, k)
    return t.customer.select("c_custkey", text.media_extension(mime, F.concat(F.lit("http://a/"), _nth(ADDRESSES, k))).alias("extension"), text.codec_of(F.concat(F.lit(" "), mime, F.lit("; q=1"))).alias("codec"), text.is_he_aac(_nth(["AAC", " AAC+ v2", "mp4a.40.2"], k)).alias("he_aac"))


@query("SELECT c_custkey, (['image/jpeg', 'image/png', 'image/gif', 'image/webp', NULL])[c_custkey % 5 + 1] AS type FROM customer")
def sniffed_types(t):
    head = F.unhex(_nth(["FFD8FFE0", "89504E470D0A1A0A00", "474946383961", "524946460000000057454250", "52494646AA"], F.col("c_custkey")))
    return t.customer.select("c_custkey", text.sniffed_type(F.concat(head, F.encode("c_name", "UTF-8"))).alias("type"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS shaped FROM part")
def uuid_shapes(t):
    h = F.md5(F.col("p_name"))
    cut = lambda i, n: F.substr(h, F.lit(i), F.lit(n))
    uuid = F.concat_ws("-", cut(1, 8), cut(9, 4), F.upper(cut(13, 4)), cut(17, 4), cut(21, 12))
    return t.part.select("p_partkey", text.is_uuid(F.when(F.col("p_partkey") % 3 == 0, uuid).when(F.col("p_partkey") % 3 == 1, h).otherwise(F.concat(uuid, F.lit("0")))).alias("shaped"))


@query("SELECT o_orderkey, CASE WHEN m < 1 THEN 'under a minute' WHEN m < 60 THEN m || ' min' WHEN m % 60 = 0 THEN m // 60 || ' h' ELSE m // 60 || ' h ' || m % 60 || ' min' END AS label FROM (SELECT o_orderkey, CAST(floor((o_orderkey * 7919 % 9000000) / 60000 + 0.5) AS BIGINT) AS m FROM orders)")
def duration_labels(t):
    return t.orders.select("o_orderkey", text.duration_label(F.col("o_orderkey") * 7919 % 9_000_000).alias("label"))


@query("SELECT c_custkey, lower(hex(c_name)) AS hexed, c_name || chr(31) || c_mktsegment AS joined, strftime(to_timestamp(c_custkey * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS day FROM customer")
def engine_functions(t):
    return t.customer.select("c_custkey", F.lower(F.hex("c_name")).alias("hexed"), F.concat("c_name", F.lit("\x1f"), "c_mktsegment").alias("joined"), F.date_format(F.timestamp_seconds(F.col("c_custkey") * 86400), "yyyy-MM-dd HH:mm:ss").alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'failed' ELSE 'done' END AS status FROM orders")
def jobs_after_restart(t):
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    return changes.jobs_after_restart(t.orders.select("o_orderkey", status.alias("status")))


@query("SELECT o_orderkey AS id, coalesce(l.n, 0) AS progress, CASE WHEN l.n IS NULL THEN 'queued' WHEN l.n > 3 THEN 'done' ELSE 'running' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def job_table(t):
    """Jobs start queued; reports of progress replace their row."""
    start = t.orders.select(F.col("o_orderkey").alias("id"), F.lit(0).cast("long").alias("progress"), F.lit("queued").alias("status"))
    told = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("progress")).join(t.orders.select(F.col("o_orderkey").alias("id")), "id", "left_semi")
    return changes.upserted(start, told.withColumn("status", F.when(F.col("progress") > 3, "done").otherwise("running")), ["id"])


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'pending' ELSE 'done' END AS enrich_status, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_orderkey % 4 END AS enrich_attempts FROM orders")
def lookups_again(t):
    return services.pending_again(t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "not_found").otherwise("done").alias("enrich_status"), (F.col("o_orderkey") % 4).alias("enrich_attempts")))


@query("""SELECT event_id, CASE WHEN user_id % 2 = 0 THEN coalesce(CASE WHEN value > 100 THEN event_id END, 777) WHEN value > 100 THEN event_id END AS played_at FROM events""")
def marked_played(t):
    rows = t.events.select("event_id", "user_id", F.when(F.col("value") > 100, F.col("event_id")).alias("played_at"))
    return changes.played_marked(rows, t.events.where("user_id % 2 = 0"), "event_id", True, 777).select("event_id", "played_at")


@query("SELECT event_id, CASE WHEN user_id % 2 <> 0 THEN event_id END AS played_at FROM events")
def marked_unplayed(t):
    return changes.played_marked(t.events.select("event_id", "user_id", F.col("event_id").alias("played_at")), t.events.where("user_id % 2 = 0"), "event_id", False, 777).select("event_id", "played_at")


@query("SELECT event_id AS id, CASE WHEN user_id % 3 = 0 THEN 5 ELSE user_id END AS offset_ms, CASE WHEN user_id % 2 = 0 THEN 'new' ELSE event_type END AS note FROM events")
def bookmarks_patched(t):
    u = F.col("user_id")
    marks = t.events.select(F.col("event_id").alias("id"), u.alias("offset_ms"), F.col("event_type").alias("note"))
    return services.patched_bookmarks(marks, t.events.select(F.col("event_id").alias("id"), F.when(u % 3 == 0, F.lit(5).cast("long")).alias("offset_ms"), F.when(u % 2 == 0, "new").alias("note")))


@query("SELECT c_custkey AS id, c_mktsegment AS name FROM customer WHERE c_custkey < 3 UNION ALL SELECT 1000 + row_number() OVER (ORDER BY c_name) - 1, c_name FROM customer")
def listeners_created(t):
    known = t.customer.where("c_custkey < 3").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"))
    return changes.got_or_created(known, t.customer.select(F.col("c_name").alias("name")), 1000)


@query("SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey <> 7, lower(c_mktsegment), c_custkey) AS place FROM customer")
def listener_list(t):
    mixed = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    rows = t.customer.select(F.col("c_custkey").alias("id"), mixed.alias("name"), (F.col("c_custkey") == 7).alias("is_default"))
    return services.listeners(rows).select("id", "place")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey <> 7, md5('42:' || p_partkey), p_partkey) - 1 AS position FROM part")
def queue_shuffled(t):
    """A seeded shuffle of all parts that keeps the one that is playing first."""
    return relational.shuffled(t.part.select("p_partkey"), 42, "p_partkey", 7)


@query("SELECT p_partkey FROM part ORDER BY md5('5:' || p_partkey), p_partkey LIMIT 25")
def random_pick(t):
    return relational.picked_at_random(t.part, 5, "p_partkey", 25).select("p_partkey")


@query("SELECT c_custkey, row_number() OVER (ORDER BY lower(c_mktsegment), c_custkey % 120, c_custkey) AS place FROM customer")
def client_places(t):
    """Every customer's place by name, whatever its case and accents, then by the number in a second name."""
    k = F.col("c_custkey")
    first = F.when(k % 3 == 0, F.lower("c_mktsegment")).when(k % 3 == 1, F.translate("c_mktsegment", "AEIOU", "ÄÉÎÕÜ")).otherwise(F.col("c_mktsegment"))
    rows = t.customer.select("c_custkey", first.alias("name"), F.concat(F.lit("Disc "), F.when(k % 2 == 0, "0").otherwise(""), k % 120).alias("disc"))
    return services.places_for_a_client(rows, ["name", "disc"], "c_custkey").select("c_custkey", "place")


@query("""WITH l AS (SELECT c_custkey AS id, CASE WHEN c_custkey = 5 THEN 'Mix' ELSE c_name END AS name FROM customer UNION ALL SELECT max(c_custkey) + 1, ' New ' FROM customer),
e AS (SELECT o_custkey AS id, count(*) AS n, CAST(max(o_orderkey) AS BIGINT) AS last FROM orders GROUP BY 1 UNION ALL SELECT (SELECT max(c_custkey) + 1 FROM customer), count(*), max_by(p_partkey, (p_size, p_partkey)) FROM part WHERE p_size < 9)
SELECT l.id, l.name, coalesce(e.n, 0) AS n, e.last FROM l LEFT JOIN e USING (id)""")
def playlists_created_and_renamed(t):
    """Playlists of customers' orders after one has been added and one renamed: their names, lengths and last tracks."""
    lists = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    entries = analytic.dense_positions(t.orders.select(F.col("o_custkey").alias("playlist_id"), F.col("o_orderkey").alias("track_id")), "playlist_id", ["track_id"])
    items = t.part.where("p_size < 9").select(F.col("p_size").alias("ord"), F.col("p_partkey").alias("track_id"))
    lists, entries = entities.created_playlist(lists, entries.select("playlist_id", F.col("position").cast("long").alias("position"), "track_id"), " New ", items)
    shown = entries.groupBy(F.col("playlist_id").alias("id")).agg(F.count("*").alias("n"), F.max_by("track_id", "position").alias("last"))
    return entities.renamed_playlist(lists, 5, "  Mix\n").join(shown, "id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@query("SELECT p_partkey AS id, p_name AS title_key, CASE WHEN p_partkey % 5 > 0 THEN lower(p_brand) END AS artist_key FROM part WHERE p_partkey % 3 = 0 OR (p_partkey % 7 = 0 AND p_partkey % 5 > 0)")
def keys_refreshed(t):
    """Albums whose stored keys are stale: a title key of another form, or an artist key that is missing."""
    k = F.col("p_partkey")
    artist = F.when(k % 5 > 0, F.concat(F.lit(" "), F.upper("p_brand")))
    stored = F.when((k % 5 > 0) & (k % 7 > 0), F.lower("p_brand"))
    albums = t.part.select(k.alias("id"), F.concat(F.initcap("p_name"), F.lit("  ")).alias("title"), artist.alias("artist"), F.when(k % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("title_key"), stored.alias("artist_key"))
    return entities.refreshed_keys(albums)


@query("SELECT user_id, event_type AS name, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2 UNION ALL SELECT c_custkey, 'theme', 1.0 FROM customer")
def listener_settings(t):
    """The last value written per listener and name; others stay."""
    old = t.customer.select(F.col("c_custkey").alias("user_id"), F.lit("theme").alias("name"), F.lit(1.0).alias("value"))
    new = analytic.latest_per_group(t.events, ["user_id", "event_type"], [F.desc("event_id")]).select("user_id", F.col("event_type").alias("name"), "value")
    return changes.upserted(old, new, ["user_id", "name"])


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'e' || o_custkey END AS file_path FROM orders")
def files_reconciled(t):
    episodes = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("e"), "o_custkey").alias("file_path"))
    return services.still_on_disk(episodes, t.customer.where("c_acctbal > 0").select(F.concat(F.lit("e"), "c_custkey").alias("path")))


@query("""SELECT 'c' || o_custkey AS name, count(*) AS n, count(DISTINCT lower(o_orderpriority)) AS kept FROM orders GROUP BY 1""")
def names_folded(t):
    """Lists without repeats that differ in case only."""
    mixed = F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority"))
    lists = t.orders.groupBy(F.concat(F.lit("c"), "o_custkey").alias("name")).agg(F.count("*").alias("n"), F.collect_list(mixed).alias("l"))
    return lists.select("name", "n", F.size(names.distinct_folded(F.col("l"))).cast("long").alias("kept"))


@query("""WITH m AS (SELECT l_orderkey AS b, l_linenumber AS n, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT b AS book_id, max_by(CAST(least(q, 40) * 1000 AS BIGINT), n) AS saved_ms, bool_or(least(q, 40) * 1000 >= 38800) AS finished FROM m GROUP BY 1""")
def positions_clamped(t):
    """Positions beyond a book's 40 s are held at its end; the last one stays, and 97 % count as finished."""
    moves = t.lineitem.groupBy(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("n")).agg(F.least(F.min("l_quantity"), F.lit(40.0)).alias("q"))
    held = moves.withColumn("ms", (F.col("q") * 1000).cast("long"))
    done = held.groupBy("book_id").agg(F.bool_or(text.finished(F.col("ms"), F.lit(40_000))).alias("finished"))
    last = analytic.latest_per_group(held, ["book_id"], [F.desc("n")]).select("book_id", F.col("ms").alias("saved_ms"))
    return last.join(done, "book_id")


_WORDS = "SELECT doc_id, lang, [x for x in [regexp_replace(y, '[^\\p{L}\\p{N}_-]', '', 'g') for y in string_split_regex(lower(coalesce(text, '')), '\\s+')] if x <> ''] AS ws FROM documents"


@query(f"""WITH s AS (SELECT doc_id, lang, len(ws) AS l, len([x for x in ws if starts_with(x, 'th')]) AS a, len([x for x in ws if starts_with(x, 'nd')]) AS b FROM ({_WORDS})),
t AS (SELECT count(*) AS n, avg(l) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM s),
r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY ln(1.0 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / mean)) + ln(1.0 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / mean)) DESC, doc_id) AS place FROM s, t WHERE a > 0 AND b > 0)
SELECT doc_id FROM r WHERE place <= 50 AND lang = 'en'""")
def search_first_fifty(t):
    """The best fifty, of which rows of other languages drop out after the cut."""
    return entities.search(t.text_index, t.documents, "th nd", "doc_id", F.col("lang") == "en").select("doc_id")
