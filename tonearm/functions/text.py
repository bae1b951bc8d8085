"""Feed, file, time and label helpers. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import ascii_lower

DAY_MS = 86_400_000

# Which names or types stand for which extension.
MIME_EXTENSIONS = (("mpeg|mp3", "mp3"), ("mp4|m4a", "m4a"), ("aac", "aac"), ("opus", "opus"), ("ogg|vorbis", "ogg"), ("flac", "flac"), ("wav", "wav"))
FORMAT_EXTENSIONS = (("mp3", "mp3"), ("flac", "flac"), ("m4a|mp4", "m4a"), ("aac", "aac"), ("wav|wave", "wav"), ("aiff|aif|aifc", "aiff"), ("ogg|oga", "ogg_vorbis"), ("opus", "opus"), ("dsf", "dsf"), ("dff", "dff"), ("iso", "sacd_iso"))
CODEC_TYPES = (("audio/mpeg|audio/mp3|audio/mpeg3|audio/x-mpeg", "MP3"), ("audio/aacp", "AAC+"), ("audio/aac|audio/x-aac|audio/mp4|audio/x-m4a", "AAC"), ("audio/ogg|application/ogg|audio/vorbis", "OGG"), ("audio/opus", "OPUS"), ("audio/flac|audio/x-flac", "FLAC"))
MAGIC = (("FFD8FF", "image/jpeg"), ("89504E470D0A1A0A", "image/png"), ("47494638", "image/gif"))


def duration_ms(c: Column) -> Column:
    """``[[h:]m:]s`` in ms; null for more parts, junk, negatives and zero."""
    parts = F.transform(F.split(F.trim(c), ":"), lambda p: F.trim(p).try_cast("double"))
    good = F.forall(parts, lambda p: p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p < F.lit(float("inf"))))
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p)
    ms = F.round(total * 1000).cast("long")
    return F.when((F.trim(c) != "") & (F.size(parts) <= 3) & good & (ms > 0), ms)


def utc_date(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def utc_day(ms: Column) -> Column:
    """Day number by floor division (``div`` would cut towards zero)."""
    return F.floor(ms / F.lit(DAY_MS))


def finished(offset: Column, duration: Column, share: float = 0.97) -> Column:
    return (duration > 0) & (offset >= duration * share)


def restart_at(offset: Column, duration: Column) -> Column:
    return F.when(finished(offset, duration), F.lit(0)).otherwise(offset)


def feed_url(c: Column) -> Column:
    """One spelling per feed address: http(s), lower-case scheme and host, no default port, fragment or lone slash; null if not an address."""
    t = F.trim(c)
    t = F.regexp_replace(t, r"(?i)^feed:(https?://)", "$1")
    t = F.regexp_replace(t, r"(?i)^(feed|itpc|pcast|podcast)://", "https://")
    t = F.when(F.contains(t, F.lit("://")), t).otherwise(F.concat(F.lit("https://"), t))
    shape = r"(?is)^(https?)://([^/?#@]*@)?([^/?#:@\s]+)(:[0-9]*)?([/?][^#]*)?(#.*)?$"
    scheme, user, host = F.lower(F.regexp_extract(t, shape, 1)), F.regexp_extract(t, shape, 2), F.lower(F.regexp_extract(t, shape, 3))
    port, rest = F.regexp_extract(t, shape, 4), F.regexp_extract(t, shape, 5)
    default = port.isin(":", "") | ((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443"))
    path = F.when(rest == "/", F.lit("")).when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(t.rlike(shape), F.concat(scheme, F.lit("://"), user, host, F.when(default, F.lit("")).otherwise(port), path))


def percent_encode(c: Column) -> Column:
    """Everything but letters, digits and ``-_.~``; a space is %20."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_query(pairs: Column) -> Column:
    """A cache key: ``k=v`` of a map, encoded, sorted, joined by ``&``."""
    items = F.transform(F.map_entries(pairs), lambda e: F.concat(percent_encode(e["key"]), F.lit("="), percent_encode(e["value"])))
    return F.array_join(F.array_sort(items), "&")


def xml_escape(c: Column) -> Column:
    """Escaped text; control characters that XML cannot hold are dropped."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def xml_unescape(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def repaired_xml(c: Column) -> Column:
    """Characters XML forbids removed, bare ampersands escaped."""
    legal = F.regexp_replace(c, r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")
    return F.regexp_replace(legal, r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#x[0-9A-Fa-f]+);)", "&amp;")


def safe_name(c: Column, most: int) -> Column:
    """A file name that any system takes; "untitled" if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(c, r'[/\\:*?"<>|]', "-"), r"\p{Cntrl}", " ")
    s = F.trim(F.substr(F.trim(F.regexp_replace(s, r"\s+", " ")), F.lit(1), F.lit(most)))
    s = F.trim(F.regexp_replace(s, r"^\.+|\.+$", ""))
    return F.when(s == "", F.lit("untitled")).otherwise(s)


def _first(cases, test, default=None):
    out = None
    for pattern, value in cases:
        out = F.when(test(pattern), F.lit(value)) if out is None else out.when(test(pattern), F.lit(value))
    return out.otherwise(F.lit(default)) if default is not None else out


def media_extension(mime: Column, url: Column) -> Column:
    """Of an enclosure: by its type, else by its address, else mp3."""
    m, path = ascii_lower(F.coalesce(mime, F.lit(""))), ascii_lower(F.regexp_extract(url, "^[^?#]*", 0))
    by_type = _first(MIME_EXTENSIONS, lambda p: m.rlike(p))
    by_path = _first([(e, e) for _, e in MIME_EXTENSIONS], lambda e: path.endswith("." + e), "mp3")
    return F.coalesce(by_type, by_path)


def format_of(path: Column) -> Column:
    """Audio format by extension in any case; null for files that aren't audio."""
    ext = ascii_lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    return _first(FORMAT_EXTENSIONS, lambda p: ext.rlike(f"^(?:{p})$"))


def is_he_aac(codec: Column) -> Column:
    return ascii_lower(F.trim(codec)).rlike(r"aac\+|aacp|aac plus|he-aac|heaac|mp4a\.40\.5|mp4a\.40\.29")


def codec_of(content_type: Column) -> Column:
    ct = ascii_lower(F.trim(F.regexp_extract(content_type, "^[^;]*", 0)))
    return _first(CODEC_TYPES, lambda p: ct.rlike(f"^(?:{p})$"))


def sniffed_type(content: Column) -> Column:
    """Content type by the first bytes; null if unknown."""
    head = F.hex(F.substr(content, F.lit(1), F.lit(12)))
    webp = head.rlike("^52494646.{8}57454250")
    return F.when(webp, F.lit("image/webp")).otherwise(_first(MAGIC, lambda p: head.startswith(p)))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def is_uuid(c: Column) -> Column:
    return c.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")


def transcode_target(source: Column, preferred: Column) -> Column:
    """What a stream is served as: the first preference, but nothing passes through that can't be streamed as it is."""
    direct = source.isNotNull() & ~source.isin("dsf", "dff", "sacd_iso")
    passed = F.when(direct, F.lit("passthrough")).otherwise(F.lit("flac"))
    return F.when(preferred.isNull() | (preferred == "passthrough"), passed).otherwise(preferred)


def clock(ms: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(ms / 1000))
    h, m, sec = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h, F.lit(":"), two(m), F.lit(":"), two(sec))).otherwise(F.concat(m, F.lit(":"), two(sec)))


def duration_label(ms: Column) -> Column:
    total = F.greatest(F.lit(0), F.floor(ms / 60_000 + 0.5))
    h, m = F.floor(total / 60), total % 60
    return F.when(total < 1, F.lit("under a minute")).when(h == 0, F.concat(m, F.lit(" min"))).when(m == 0, F.concat(h, F.lit(" h"))).otherwise(F.concat(h, F.lit(" h "), m, F.lit(" min")))


def size_label(n: Column) -> Column:
    kb = F.concat(F.greatest(F.lit(1), F.floor(n / 1024 + 0.5)), F.lit(" KB"))
    return F.when(n < 1 << 20, kb).when(n < 1 << 30, F.concat(F.format_string("%.1f", n / float(1 << 20)), F.lit(" MB"))).when(n.isNull(), F.lit("")).otherwise(F.concat(F.format_string("%.2f", n / float(1 << 30)), F.lit(" GB")))


def binomial_tail(n: Column, k: Column) -> Column:
    """Chance of k or more successes in n fair trials."""
    start = F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("sum"))

    def step(acc, i):
        nxt = acc["c"] * (n - i).cast("double") / (i + 1).cast("double")
        return F.struct(nxt.alias("c"), (acc["sum"] + F.when(i >= k, acc["c"]).otherwise(0.0)).alias("sum"))

    return F.aggregate(F.sequence(F.lit(0), n.cast("int")), start, step, lambda a: a["sum"] / F.pow(F.lit(2.0), n))


def listened_ms(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), end - start)


def progress(position: Column, duration: Column) -> Column:
    return F.when(duration > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), position / duration))).otherwise(0.0)
