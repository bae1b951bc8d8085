import struct

from pyspark.sql import functions as F

from tonearm.sources import feeds, media, playlists


def test_m3u(spark):
    text = "#EXTM3U\r\n\r\n#EXTINF:12,One\n# note\na.mp3\nb.mp3\n#EXTINF:3,\nc.mp3\n#EXTINF:1,Lost\n#EXTINF:2,Four, five\nd.mp3"
    got = playlists.m3u_entries(spark.createDataFrame([("p", text), ("q", "")], "name string, text string")).orderBy("pos").collect()
    assert [(r.raw, r.title) for r in got] == [("a.mp3", "One"), ("b.mp3", None), ("c.mp3", None), ("d.mp3", "Four, five")]


def test_playlist_writers(spark):
    rows = [("p", 1, "/m/b c.mp3", "B & C", None, None, False, True), ("p", 0, "/m/a.mp3", "A", "X", 61_000, False, True), ("p", 2, "/m/z.mp3", "Z", None, None, True, True)]
    t = spark.createDataFrame(rows, "name string, pos long, path string, title string, artist string, duration_ms long, missing boolean, decodable boolean")
    ok, skipped = playlists.exported(t)
    assert skipped.first().skipped == 1
    assert playlists.to_m3u(ok).first().text == "#EXTM3U\n#EXTINF:61,X - A\n/m/a.mp3\n#EXTINF:-1,B & C\n/m/b c.mp3\n"
    assert playlists.to_pls(ok).first().text.endswith("File2=/m/b c.mp3\nTitle2=B & C\nLength2=-1\nNumberOfEntries=2\nVersion=2\n")
    xml = playlists.to_xspf(ok).first().text
    assert "<location>file:///m/b%20c.mp3</location>\n      <title>B &amp; C</title>\n    </track>" in xml and "<duration>61000</duration>" in xml and "  <title>p</title>\n  <trackList>" in xml
    again = playlists.m3u_entries(playlists.to_m3u(ok)).orderBy("pos").collect()
    assert [r.raw for r in again] == ["/m/a.mp3", "/m/b c.mp3"]


def test_playlist_writers_odd_tags(spark):
    rows = [("p", 0, "/m/x.y.mp3", " \n ", "a\r\nb\tc ", 0), ("p", 4, "/m/.hid", None, None, 1), ("p", 9, "/m/q", "T", "", 499), ("p", 11, "/m/r", "U", None, 1500), ("p", 12, "/m/s\u0085t.ogg", None, None, 2499)]
    t = spark.createDataFrame(rows, "name string, pos long, path string, title string, artist string, duration_ms long")
    assert [x for x in playlists.to_m3u(t).first().text.split("\n") if x.startswith("#EXTINF")] == ["#EXTINF:-1,a  b c - x.y", "#EXTINF:1,.hid", "#EXTINF:1,T", "#EXTINF:2,U", "#EXTINF:2,s t"]
    pls = playlists.to_pls(t).first().text
    assert "Title1=a  b c - x.y\nLength1=-1\nFile2=/m/.hid\n" in pls and "NumberOfEntries=5\n" in pls
    xml = playlists.to_xspf(t).first().text
    assert xml.count("<duration>") == 4 and "<creator>a  b c</creator>" in xml and xml.count("<creator>") == 1


FEED = """<?xml version="1.0"?><rss><channel><title>T</title>
<item><title><![CDATA[One & only]]></title><guid>g1</guid><enclosure url="http://x/1.mp3?a=1&b=2" type="audio/mpeg"/><pubDate>Mon, 02 Mar 2026 10:00:00 +0000</pubDate><itunes:duration>1:02:03</itunes:duration></item>
<item><title>Two</title><enclosure url="https://x/2.mp3" type="audio/mpeg"/></item>
<item><title>Again</title><guid>g1</guid><enclosure url="http://x/3.mp3" type="audio/mpeg"/></item>
<item><title>Video</title><guid>g4</guid><enclosure url="http://x/4.mp4" type="video/mp4"/></item>
<item><title>None</title><guid>g5</guid></item>
<item><title>Odd</title><guid>g6</guid><enclosure url="ftp://x/6.mp3" type="audio/mpeg"/></item>
<item><title>Newer</title><guid>g7</guid><enclosure url="http://x/7.mp3" type="audio/mpeg"/><pubDate>Tue, 03 Mar 2026 10:00:00 +0000</pubDate></item>
<item><title>Cut off</title><guid>g8</guid><enclosure url="http://x/8.mp3" """


def test_feed(spark):
    got = feeds.newest_first(feeds.feed_items(spark.createDataFrame([(1, FEED), (2, "junk")], "feed_id long, text string"))).collect()
    assert [(r.guid, r.title, r.enclosure_url) for r in got] == [("g7", "Newer", "http://x/7.mp3"), ("g1", "One & only", "http://x/1.mp3?a=1&b=2"), ("https://x/2.mp3", "Two", "https://x/2.mp3")]
    assert got[1].duration_ms == 3_723_000 and got[1].published_at == 1_772_445_600_000 and got[2].published_at is None


def test_text_decoding(spark):
    rows = [("é".encode(),), ("é“".encode("cp1252"),), ("hi".encode("utf-16"),)]
    assert [r.o for r in spark.createDataFrame(rows, "b binary").select(feeds.decoded(F.col("b")).alias("o")).collect()] == ["é", "é“", "hi"]


def test_opml_and_links(spark):
    lists = spark.createDataFrame([("s", 0, "http://a/f?x=1&y=2", "A & B"), ("s", 1, "http://b/f", None)], "name string, pos long, url string, title string")
    back = feeds.opml_feeds(feeds.to_opml(lists)).orderBy("pos").collect()
    assert [(r.url, r.title) for r in back] == [("http://a/f?x=1&y=2", "A & B"), ("http://b/f", "http://b/f")]
    page = '<link rel="stylesheet" href="x.css"><LINK rel="alternate" type="application/rss+xml" title="F" href="/f.xml"/><link rel=alternate>'
    got = feeds.feed_links(spark.createDataFrame([(1, page)], "id long, h string"), "id", "h").collect()
    assert [(r.href, r.title) for r in got] == [("/f.xml", "F")]


def test_notes(spark):
    cases = {'<p onclick="x">a<script>b</script>c</p>': "<p>ac</p>", '<a href="javascript:x">t</a>': "t", '<a href="https://x?a&b">t</a>': '<a href="https://x?a&amp;b">t</a>', "a &lt; b<br/>": "a &lt; b<br>", "<table><td>x": "x"}
    assert [feeds.safe_notes(c) for c in cases] == list(cases.values())
    assert spark.createDataFrame([("<b>x</b><style>y</style>",)], "s string").select(feeds.safe_notes_udf("s").alias("o")).first().o == "<b>x</b>"


def test_directories(spark):
    body = '[{"stationuuid":"u","name":" A ","url":"","url_resolved":"http://r","bitrate":"128"},{"name":"","url":"x"},{"name":"B","url":"http://b","bitrate":0,"codec":" "},{"name":"C"}]'
    got = feeds.stations(spark.createDataFrame([(body,), ("junk",)], "body string")).collect()
    assert [(r.name, r.url, r.bitrate, r.codec) for r in got] == [("A", "http://r", 128, None), ("B", "http://b", None, None)]
    assert [r.stations for r in feeds.facets(spark.createDataFrame([('[{"name":"x","stationcount":"7"},{"name":"y","stationcount":0}]',)], "body string")).collect()] == [7]
    rel = '{"releases":[{"id":"m","score":"90","title":"T","artist-credit":[{"name":"A"},{"name":"B"}],"date":"1999-02","track-count":5},{"title":"no id"}]}'
    r = feeds.releases(spark.createDataFrame([(1, rel)], "query_id long, body string")).collect()
    assert [(x.mbid, x.artist, x.track_count, x.score, x.year) for x in r] == [("m", "A, B", 5, 90, 1999)]
    b = feeds.books(spark.createDataFrame([(1, '{"docs":[{"key":"k","title":"T","first_publish_year":1950},{"key":"z"}]}')], "query_id long, body string")).collect()
    assert [(x.title, x.authors, x.year) for x in b] == [("T", [], 1950)]
    eq = feeds.eq_profile(spark.createDataFrame([("p", "Preamp: -6.1 dB\nFilter 1: ON PK Fc 105 Hz Gain -2.5 dB Q 0.70\nFilter 2: OFF PK Fc 1 Hz Gain 1 dB\nFilter 3: ON LSC Fc 50 Hz Gain 3 dB")], "name string, text string")).orderBy("pos").collect()
    assert [(x.kind, x.freq, x.gain_db, x.q) for x in eq] == [("preamp", None, -6.1, None), ("peaking", 105.0, -2.5, 0.7), ("low_shelf", 50.0, 3.0, 0.707)]


def _box(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


def _id3(frames):
    body = b"".join(k + struct.pack(">I", len(v) + 1) + b"\0\0\x03" + v for k, v in frames.items())
    n = len(body)
    return b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body


def test_containers(spark, tmp_path):
    chpl = b"\x01\0\0\0\0\0\0\0\x02" + struct.pack(">QB", 0, 3) + b"One" + struct.pack(">QB", 50_000_000, 3) + b"Two"
    mp4 = _box(b"ftyp", b"M4B ") + _box(b"moov", _box(b"udta", _box(b"chpl", chpl)))
    assert media.mp4_chapters(mp4) == [(0, "One"), (5000, "Two")] and media.mp4_chapters(mp4[:-4]) == [] and media.mp4_chapters(b"x") == []
    tag = _id3({b"TIT2": b"Song", b"TPE1": b"Who"})
    audio = b"data" + struct.pack("<Q", 12 + 4) + b"\x69" * 4
    dsf = b"DSD " + struct.pack("<QQQ", 28, 0, 28 + 52 + len(audio)) + b"fmt " + struct.pack("<QIIIIIIQII", 52, 1, 0, 2, 2, 2_822_400, 1, 2_822_400, 4096, 0) + audio + tag
    h = media.dsf_header(dsf)
    assert h["channels"] == 2 and h["sample_rate"] == 2_822_400 and h["lsb_first"]
    prop = b"SND " + b"FS  " + struct.pack(">QI", 4, 2_822_400) + b"CHNL" + struct.pack(">QH", 2, 2)
    inner = b"DSD " + b"PROP" + struct.pack(">Q", len(prop)) + prop + b"DSD " + struct.pack(">Q", 4) + b"\0" * 4
    dff = b"FRM8" + struct.pack(">Q", len(inner)) + inner
    assert media.dff_header(dff)["samples"] == 16 and not media.dff_header(dff)["lsb_first"]
    (tmp_path / "A" / "CD1").mkdir(parents=True)
    (tmp_path / "A" / "CD1" / "a.DSF").write_bytes(dsf)
    (tmp_path / "A" / "b.m4a").write_bytes(mp4)
    (tmp_path / "A" / "c.txt").write_bytes(b"x")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "d.mp3").write_bytes(b"x")
    files = media.walked(spark, str(tmp_path), [str(tmp_path / "skip")], content=True)
    got = {r.path.rsplit("/", 1)[1]: r for r in media.tagged(files).collect()}
    assert set(got) == {"a.DSF", "b.m4a"} and got["a.DSF"].title == "Song" and got["a.DSF"].duration_ms == 1000
    assert [c.title for c in got["b.m4a"].chapters] == ["One", "Two"]
    assert media.books_of(files).count() == 1


def test_a_feed_is_read_once(spark):
    item = "<item><title>A &amp; B</title><guid>g</guid><enclosure url='https://x/{}' type='{}'/></item>"
    text = "<rss>" + item.format(0, "video/mp4") + item.format(1, "audio/mpeg") + item.format(2, "audio/mpeg") + "</rss>"
    df = feeds.feed_items(spark.createDataFrame([(1, text)], "feed_id long, text string"))
    assert [(r.guid, r.pos, r.title, r.enclosure_url) for r in df.collect()] == [("g", 1, "A & B", "https://x/1")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("item|entry") == 1 and plan.count("<enclosure") == 1  # before: a second reading for the first of each guid
