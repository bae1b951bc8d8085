"""Podcast feeds, OPML, feed links in pages, show notes, and JSON directories."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.functions.names import bound
from tonearm.functions.text import duration_ms, repaired_xml, xml_escape, xml_unescape

ITEMS_MOST = 10_000
# Tags that show notes may keep, and tags that go with all they hold.
KEPT_TAGS = set("p br a ul ol li strong b em i u blockquote h1 h2 h3 h4 h5 h6 code pre hr span div".split())
DROPPED_TAGS = set("script style iframe object embed noscript template form svg math head title".split())
VOID_TAGS = {"br", "hr"}


# Windows-1252 characters for bytes 0x80-0x9F, where they differ from Latin-1.
CP1252 = {0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ"}


def decoded(content):
    """Bytes to text: a byte-order mark decides, else UTF-8, else Windows-1252."""
    utf16 = F.hex(F.substr(content, F.lit(1), F.lit(2))).isin("FFFE", "FEFF")
    latin = F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, CP1252)), "".join(CP1252.values()))
    return F.when(utf16, F.decode(content, "UTF-16")).when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(latin)


def _tag(block, name: str):
    """Text of the first <name> in a block, CDATA unwrapped, entities read; null if blank."""
    cdata = r"(?s)^\s*<!\[CDATA\[(.*?)(?:\]\]>)?\s*$"

    def text(raw):
        kept = F.replace(F.regexp_extract(raw, cdata, 1), F.lit("&amp;"), F.lit("&"))  # the repair escaped bare ampersands here too
        return F.trim(F.when(raw.rlike(cdata), kept).otherwise(xml_unescape(raw)))

    raw = F.regexp_extract(block, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}\s*>", 1)
    return bound(bound(raw, text), lambda t: F.when(t != "", t))


def feed_items(feeds: DataFrame) -> DataFrame:
    """Episodes of feed texts (feed_id, text), truncated or faulty ones included: what is whole is read.

    Without an http(s) enclosure, and video: dropped.  No guid: the address stands for it.  A repeated guid
    keeps the first.  At most 10,000 items a feed, in document order; ``pos`` is that order.
    """
    whole = r"(?is)<(item|entry)(?:\s[^>]*)?>.*?</\1\s*>"
    blocks = F.slice(F.regexp_extract_all(repaired_xml(F.col("text")), F.lit(whole), F.lit(0)), 1, ITEMS_MOST)
    item = feeds.select("feed_id", F.posexplode(blocks).alias("pos", "b"))
    enclosure = F.regexp_extract("b", r"(?is)<enclosure\s[^>]*>", 0)
    link = F.regexp_extract("b", r"""(?is)<link\s[^>]*rel=["']enclosure["'][^>]*>""", 0)
    tag = bound(enclosure, lambda e: F.when(e != "", e).otherwise(link))
    attr = lambda t, names: xml_unescape(F.regexp_extract(t, rf"""(?is)\s(?:{names})\s*=\s*["']([^"']*)["']""", 1))
    media = bound(tag, lambda t: F.struct(F.trim(attr(t, "url|href")).alias("url"), F.lower(attr(t, "type")).alias("mime")))
    audio = lambda m: F.lower(m["url"]).rlike("^https?://") & ~m["mime"].startswith("video/")
    read = lambda m: F.struct(
        F.coalesce(_tag(F.col("b"), "guid"), _tag(F.col("b"), "id"), m["url"]).alias("guid"), _tag(F.col("b"), "title").alias("title"), m["url"].alias("enclosure_url"), m["mime"].alias("mime"),
        _tag(F.col("b"), "(?:pubDate|published|updated)").alias("published"), bound(_tag(F.col("b"), "itunes:duration"), duration_ms).alias("duration_ms"),
    )
    # One generated row, or none: an explode is where Spark neither repeats what made its rows nor moves a filter before it.
    rows = item.select("feed_id", "pos", F.explode(F.filter(F.array(bound(media, lambda m: F.when(audio(m), read(m)))), lambda e: e.isNotNull())).alias("e"))
    first = rows.groupBy("feed_id", F.col("e.guid").alias("guid")).agg(F.min_by(F.struct("pos", "e"), "pos").alias("r")).select("feed_id", "guid", "r.pos", *[f"r.e.{c}" for c in ("title", "enclosure_url", "mime", "published", "duration_ms")])
    stamp = F.coalesce(F.expr("try_to_timestamp(regexp_replace(published, '^[A-Za-z]+, *', ''), 'd MMM yyyy HH:mm:ss Z')"), F.expr("try_to_timestamp(published)"))
    return first.withColumn("published_at", F.unix_millis(stamp)).drop("published")


def newest_first(items: DataFrame) -> DataFrame:
    """Undated items last, in document order."""
    return items.orderBy("feed_id", F.desc_nulls_last("published_at"), "pos")


def feed_links(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, pos, href, title) of alternate links to feeds in pages."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<link\s[^>]*>"), F.lit(0))
    each = pages.select(id_col, F.posexplode(tags).alias("pos", "t"))
    attr = lambda n: xml_unescape(F.regexp_extract("t", rf"""(?is)\s{n}\s*=\s*["']([^"']*)["']""", 1))
    feed = F.lower(attr("rel")).rlike(r"\balternate\b") & F.lower(attr("type")).rlike(r"^application/(rss|atom)\+xml")
    return each.where(feed & (attr("href") != "")).select(id_col, "pos", attr("href").alias("href"), attr("title").alias("title"))


def opml_feeds(texts: DataFrame) -> DataFrame:
    """(name, pos, url, title) of subscription lists."""
    tags = F.regexp_extract_all(F.col("text"), F.lit(r"(?is)<outline\s[^>]*>"), F.lit(0))
    each = texts.select("name", F.posexplode(tags).alias("pos", "t"))
    attr = lambda n: xml_unescape(F.regexp_extract("t", rf"""(?is)\s{n}\s*=\s*["']([^"']*)["']""", 1))
    return each.where(F.trim(attr("xmlUrl")) != "").select("name", "pos", F.trim(attr("xmlUrl")).alias("url"), F.nullif(F.coalesce(F.nullif(attr("title"), F.lit("")), attr("text")), F.lit("")).alias("title"))


def to_opml(feeds: DataFrame) -> DataFrame:
    """One list per name from (name, pos, url, title)."""
    line = F.concat(F.lit('<outline type="rss" text="'), xml_escape(F.coalesce("title", "url")), F.lit('" xmlUrl="'), xml_escape(F.col("url")), F.lit('"/>'))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "\n")
    return feeds.groupBy("name").agg(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<opml version="2.0"><body>\n'), body, F.lit("\n</body></opml>\n")).alias("text"))


class _Notes(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.links = [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED_TAGS:
            self.skip += tag not in ("embed",)
        elif not self.skip and tag in KEPT_TAGS:
            href = dict(attrs).get("href") if tag == "a" else None
            good = bool(href and re.match(r"(?i)^(https?://|mailto:)", href.strip()))
            if tag == "a":
                self.links.append(good)
                if not good:
                    return
            self.out.append(f'<a href="{_quoted(href.strip())}">' if good else f"<{tag}>")

    def handle_endtag(self, tag):
        if tag in DROPPED_TAGS:
            self.skip = max(0, self.skip - 1)
        elif not self.skip and tag in KEPT_TAGS - VOID_TAGS:
            if tag == "a" and not (self.links and self.links.pop()):
                return
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))


def _quoted(s: str) -> str:
    return s.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")


def safe_notes(html: str | None) -> str | None:
    """Show notes with allowed tags only, no script, and links to http(s) and mail only."""
    if html is None:
        return None
    p = _Notes()
    p.feed(html)
    p.close()
    return "".join(p.out)


@F.pandas_udf(T.StringType())
def safe_notes_udf(s: pd.Series) -> pd.Series:
    return s.map(safe_notes)


def number(c):
    """JSON numbers may come as text."""
    return F.trim(c).try_cast("double")


def stations(rows: DataFrame) -> DataFrame:
    """Radio stations of a JSON directory (column body: an array): name and an address are required; bitrates that aren't positive are null."""
    schema = "array<struct<stationuuid:string,name:string,url:string,url_resolved:string,codec:string,bitrate:string,homepage:string>>"
    s = rows.select(F.explode(F.from_json("body", schema)).alias("s")).select("s.*")
    address = F.coalesce(F.nullif(F.trim("url_resolved"), F.lit("")), F.nullif(F.trim("url"), F.lit("")))
    rate = number(F.col("bitrate")).cast("long")
    out = s.select(F.nullif(F.trim("stationuuid"), F.lit("")).alias("uuid"), F.trim("name").alias("name"), address.alias("url"), F.nullif(F.trim("codec"), F.lit("")).alias("codec"), F.when(rate > 0, rate).alias("bitrate"))
    return out.where("name <> '' AND url IS NOT NULL")


def facets(rows: DataFrame) -> DataFrame:
    s = rows.select(F.explode(F.from_json("body", "array<struct<name:string,stationcount:string>>")).alias("s"))
    return s.select(F.trim("s.name").alias("name"), number(F.col("s.stationcount")).cast("long").alias("stations")).where("name <> '' AND stations > 0")


def releases(rows: DataFrame) -> DataFrame:
    schema = "struct<releases:array<struct<id:string,score:string,title:string,`artist-credit`:array<struct<name:string>>,date:string,`track-count`:string>>>"
    r = rows.select("query_id", F.posexplode(F.from_json("body", schema)["releases"]).alias("pos", "r"))
    artist = F.array_join(F.transform("r.artist-credit", lambda a: a["name"]), ", ")
    return r.select("query_id", "pos", F.col("r.id").alias("mbid"), F.col("r.title").alias("title"), artist.alias("artist"), number(F.col("r.track-count")).cast("int").alias("track_count"), F.coalesce(number(F.col("r.score")).cast("int"), F.lit(0)).alias("score"), F.substr("r.date", F.lit(1), F.lit(4)).try_cast("int").alias("year")).where("mbid IS NOT NULL AND title IS NOT NULL")


def books(rows: DataFrame) -> DataFrame:
    schema = "struct<docs:array<struct<key:string,title:string,author_name:array<string>,first_publish_year:string,cover_i:string>>>"
    r = rows.select("query_id", F.posexplode(F.from_json("body", schema)["docs"]).alias("pos", "r"))
    return r.select("query_id", "pos", F.col("r.key").alias("key"), F.col("r.title").alias("title"), F.coalesce("r.author_name", F.array().cast("array<string>")).alias("authors"), number(F.col("r.first_publish_year")).cast("int").alias("year"), number(F.col("r.cover_i")).cast("long").alias("cover")).where("title IS NOT NULL")


def eq_profile(files: DataFrame) -> DataFrame:
    """(name, pos, kind, freq, gain_db, q) and the preamp row (pos -1) of parametric EQ texts."""
    lines = files.select("name", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "s"))
    pre = r"(?i)^\s*preamp:\s*(-?[0-9.]+)\s*dB"
    band = r"(?i)^\s*filter\s*[0-9]*:\s*ON\s+(PK|LSC?|HSC?|LPQ?|HPQ?)\s+Fc\s+([0-9.]+)\s*Hz(?:\s+Gain\s+(-?[0-9.]+)\s*dB)?(?:\s+Q\s+([0-9.]+))?"
    kinds = F.create_map(*[F.lit(x) for kv in (("PK", "peaking"), ("LS", "low_shelf"), ("LSC", "low_shelf"), ("HS", "high_shelf"), ("HSC", "high_shelf"), ("LP", "low_pass"), ("LPQ", "low_pass"), ("HP", "high_pass"), ("HPQ", "high_pass")) for x in kv])
    num = lambda i: F.regexp_extract("s", band, i).try_cast("double")
    bands = lines.where(F.col("s").rlike(band)).select("name", "pos", kinds[F.upper(F.regexp_extract("s", band, 1))].alias("kind"), num(2).alias("freq"), F.coalesce(num(3), F.lit(0.0)).alias("gain_db"), F.coalesce(num(4), F.lit(0.707)).alias("q"))
    preamp = lines.where(F.col("s").rlike(pre)).select("name", F.lit(-1).alias("pos"), F.lit("preamp").alias("kind"), F.lit(None).cast("double").alias("freq"), F.regexp_extract("s", pre, 1).try_cast("double").alias("gain_db"), F.lit(None).cast("double").alias("q"))
    return bands.unionByName(preamp)
