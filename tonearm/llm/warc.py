"""WARC archives: a writer with revisit records, and a salvage reader.

The reader checks every record (gzip member and its checksum, version line, headers, block length,
record end, block and payload digests).  Where a check fails it searches for the next member or
version line, whichever comes first, at which a whole record passes, goes on there, and returns the bytes between as a gap
row with the reason.

The decompressed bytes of a member are salvaged in the same way: its rows share the member's ``offset`` and
``length``, ``inner_offset`` and ``inner_length`` are theirs within it.  Of a member that is cut off or fails
to decompress, what came out before is salvaged too; its records carry the member's fault as ``reason``, as
digests don't cover headers, and where it fails otherwise than by its end, a record needs a block digest.
A member without one good record is one gap.

Values may be of any length.  Null html: an empty payload.  Null page_id: a record without a page number, always a response unless
a numbered page has the same payload.  Equal page_ids with equal payloads are all responses.  An empty
table writes nothing.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import open_file, put_file, shared_dir, written

MANIFEST = "path string, records long, bytes long"
ROWS = (
    "path string, offset long, length long, inner_offset long, inner_length long, kind string, reason string, record_type string, record_id string, "
    "refers_to string, target_uri string, headers map<string,string>, payload_bytes long, payload_digest string, payload binary"
)
BROADCAST_ROWS = 100_000
SALTS = 32
CUT_OFF = "member is cut off"
GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."  # where a member and a record start
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_SCHEMA = pa.schema(
    [("path", pa.string())]
    + [(c, pa.int64()) for c in ("offset", "length", "inner_offset", "inner_length")]
    + [(c, pa.string()) for c in ("kind", "reason", "record_type", "record_id", "refers_to", "target_uri")]
    + [("headers", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes, refers_to: str | None = None, payload_digest: str | None = None, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record. A revisit holds only HTTP headers, whose Content-Length is the full payload's."""
    clean = re.sub(r"\s", lambda m: "%%%02X" % ord(m[0]) if ord(m[0]) < 128 else "", uri)
    digest = payload_digest or base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, "WARC-Target-URI": clean}
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{refers_to}>"}
    head |= {"WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_pages(pages: DataFrame, gzip_level: int = 4, file_bytes: int = 32 << 20, compress: bool = True) -> DataFrame:
    """Writes one record per page and returns the manifest of archives.

    The largest page_id of each payload is its response.  Only payloads that occur more than once are
    looked up, by digest: broadcast up to ``BROADCAST_ROWS`` of them; beyond, joined by a shuffle in which every digest
    has ``SALTS`` places, so that a payload of a third of all pages (the empty one) is many tasks' work.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("about:blank")).alias("url"), payload.alias("html"))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload.cast("binary")).alias("sha"))
    shared = written(keyed.groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper")).where("n > 1 AND keeper IS NOT NULL").drop("n"), "warc-shared")
    few = shared.count() <= BROADCAST_ROWS
    marked = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    if few:
        marked = marked.join(F.broadcast(shared), "sha", "left")
    else:
        spread = shared.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        marked = marked.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(spread, ["sha", "salt"], "left")

    def write(batches_in):
        held, records, size = [], 0, 0

        def flush():
            nonlocal held, records, size
            path = f"{folder}/{uuid.uuid4().hex}.warc{'.gz' if compress else ''}"
            put_file(path, b"".join(held))
            row = pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})
            held, records, size = [], 0, 0
            return row

        for batch in batches_in:
            for i in range(batch.num_rows):
                page, url, html, keeper = (batch.column(c)[i].as_py() for c in ("page_id", "url", "html", "keeper"))
                body = html.encode()
                digest = base32_sha1(body)
                own = f"urn:page:{page}" if page is not None else f"urn:uuid:{uuid.uuid4()}"
                again = keeper is not None and (page is None or page < keeper)
                raw = record("revisit" if again else "response", own, url, body, f"urn:page:{keeper}" if again else None, digest)
                held.append(_gzip(raw, gzip_level) if compress else raw)
                records, size = records + 1, size + len(held[-1])
                if size >= file_bytes:
                    yield flush()
        if held:
            yield flush()

    return written(marked.select("page_id", "url", "html", "keeper").mapInArrow(write, MANIFEST), "warc-manifest")


class _Bad(Exception):
    pass


class _Bytes:
    """Reads of a seekable file by position, through one window."""

    def __init__(self, f, window: int = 1 << 20):
        self.f, self.window, self.at, self.buf = f, window, 0, b""
        f.seek(0, 2)
        self.size = f.tell()

    def get(self, pos: int, n: int) -> bytes:
        if pos < self.at or pos + n > self.at + len(self.buf):
            self.f.seek(pos)
            self.at, self.buf = pos, self.f.read(max(n, self.window))
        return self.buf[pos - self.at : pos - self.at + n]

    def find(self, what: bytes, pos: int) -> int:
        step = self.window - len(what)
        while pos < self.size:
            hit = self.get(pos, self.window).find(what)
            if hit >= 0:
                return pos + hit
            pos += step
        return -1


def _headers(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in raw.decode("utf-8", "replace").splitlines():
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            out[last] = value.strip()
        elif line:
            raise _Bad("bad header line")
    return out


def _digest_ok(said: str | None, data: bytes) -> bool:
    if not said or not said.lower().startswith("sha1:"):
        return True
    value = said[5:].strip()
    return value.upper() == base32_sha1(data) or value.lower() == hashlib.sha1(data).hexdigest()


def _parse(get, size: int | None, pos: int) -> tuple[dict, int]:
    """The record at ``pos`` and where it ends; get(pos, n) reads."""
    head, n = b"", 4096
    while True:
        head = get(pos, n)
        if not _VERSION.match(head):
            raise _Bad("no version line")
        end = re.search(rb"\r?\n\r?\n", head)
        if end:
            break
        if len(head) < n:
            raise _Bad("headers don't end")
        _headers(head[head.index(b"\n") + 1 : head.rindex(b"\n") + 1])  # junk fails here, before the whole file is read
        n *= 4
    fields = _headers(head[head.index(b"\n") + 1 : end.start()])
    length = fields.get("content-length", "")
    if not length.isdecimal():
        raise _Bad("no block length")
    start = pos + end.end()
    stop = start + int(length)
    if size is not None and stop > size:
        raise _Bad("block is cut off")
    block = get(start, int(length))
    if len(block) < int(length):
        raise _Bad("block is cut off")
    if get(stop, 4) != b"\r\n\r\n":
        raise _Bad("no record end")
    if not _digest_ok(fields.get("warc-block-digest"), block):
        raise _Bad("block digest differs")
    kind, payload, full = fields.get("warc-type", ""), block, int(length)
    if "application/http" in fields.get("content-type", ""):
        http, sep, payload = block.partition(b"\r\n\r\n")
        full = len(payload)
        if kind == "revisit":
            said = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
            full = int(said[1]) if said else None
    told = fields.get("warc-payload-digest")
    if kind != "revisit" and not _digest_ok(told, payload):
        raise _Bad("payload digest differs")
    digest = told.partition(":")[2] if kind == "revisit" and told else base32_sha1(payload)
    row = {"record_type": kind, "record_id": fields.get("warc-record-id", "").strip("<>"), "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None}
    row |= {"target_uri": fields.get("warc-target-uri"), "headers": list(fields.items()), "payload_bytes": full, "payload_digest": digest, "payload": payload}
    return row, stop + 4


class _Held:
    """Reads of bytes in memory, as of a file."""

    def __init__(self, data: bytes):
        self.data, self.size, self.find = data, len(data), data.find

    def get(self, pos: int, n: int) -> bytes:
        return self.data[pos : pos + n]


def _inflated(src: _Bytes, pos: int) -> tuple[bytes, int | None, str]:
    """What the gzip member at ``pos`` decompresses to, where it ends (None: broken) and what is wrong."""
    z, out, at = zlib.decompressobj(31), [], pos
    try:
        while not z.eof:
            chunk = src.get(at, min(1 << 16, src.size - at)) if at < src.size else b""
            if not chunk:
                return b"".join(out), None, CUT_OFF
            out.append(z.decompress(chunk))
            at += len(chunk) - len(z.unused_data)
        return b"".join(out), at, ""
    except zlib.error as e:
        why = "bad member: " + str(e)[:60]
    z, out, i = zlib.decompressobj(31), [], pos
    try:
        while i < src.size:  # again, and the failing chunk byte by byte
            chunk = src.get(i, min(1 << 16, at - i) if i < at else 1)
            out.append(z.decompress(chunk))
            i += len(chunk)
    except zlib.error:
        pass
    return b"".join(out), None, why


def _fed(src: _Bytes, pos: int, n: int) -> int:
    """The position before which the member at ``pos`` gives its first ``n`` bytes."""
    z, total = zlib.decompressobj(31), 0
    while True:
        before, chunk = z.copy(), src.get(pos, min(4096, src.size - pos))
        try:
            got = len(z.decompress(chunk))
        except zlib.error:
            break
        if total + got >= n:
            break
        total, pos = total + got, pos + len(chunk)
    for k in range(len(chunk)):
        total += len(before.decompress(chunk[k : k + 1]))
        if total >= n:
            return pos + k + 1
    return pos + len(chunk)


def _inner(data: bytes, proof: bool) -> Iterator[dict]:
    """Record and gap rows within a member's bytes; with ``proof`` a record needs a block digest."""
    src, pos, bad_from, why = _Held(data), 0, None, ""

    def gap(stop):
        return {"kind": "gap", "inner_offset": bad_from, "inner_length": stop - bad_from, "reason": why}

    while pos < src.size:
        try:
            row, end = _parse(src.get, src.size, pos)
            if proof and not dict(row["headers"]).get("warc-block-digest", "").lower().startswith("sha1:"):
                raise _Bad("no block digest in a bad member")
        except _Bad as e:
            if bad_from is None:
                bad_from, why = pos, str(e)
            nxt = src.find(VERSION, pos + 1)
            pos = nxt if nxt >= 0 else src.size
            continue
        if bad_from is not None:
            yield gap(pos)
            bad_from = None
        yield {"kind": "record", "inner_offset": pos, "inner_length": end - pos, "reason": None, **row}
        pos = end
    if bad_from is not None:
        yield gap(src.size)


def _member(src: _Bytes, pos: int) -> tuple[Iterator[dict], int | None, int]:
    """Rows of the gzip member at ``pos``, where it ends (None: broken) and where to search on if it is broken."""
    data, end, fault = _inflated(src, pos)
    rows, lead = _inner(data, fault not in ("", CUT_OFF)), []
    for row in rows:
        lead.append(row)
        if row["kind"] == "record":
            break
    else:
        raise _Bad(fault or (lead[0]["reason"] if lead else "empty member"))
    if end is not None:
        return chain(lead, rows), end, end
    held = [r | {"reason": r["reason"] or fault} for r in chain(lead, rows)]
    good = max(r["inner_offset"] + r["inner_length"] for r in held if r["kind"] == "record")
    held.append({"kind": "gap", "inner_offset": len(data), "inner_length": 0, "reason": fault})
    return iter(held), None, _fed(src, pos, good)


class _Marks:
    """Where the next gzip member or version line may start; each mark is searched once over the file."""

    def __init__(self, src: _Bytes):
        self.src, self.next = src, {GZIP: -1, VERSION: -1}

    def after(self, pos: int) -> int:
        for what, at in self.next.items():
            if at < pos:
                hit = self.src.find(what, pos)
                self.next[what] = hit if hit >= 0 else self.src.size
        return min(self.next.values())


def salvage(f) -> Iterator[dict]:
    """Record and gap rows of one archive, in file order; every byte is in exactly one of them, or in those of one member."""
    src = _Bytes(f)
    marks, pos = _Marks(src), 0
    left: tuple | None = None  # where bytes started that no good end follows yet, and their rows

    def taken(start, rows, stop):
        for row in rows:
            yield {"offset": start, "length": stop - start, **row}

    while pos < src.size:
        try:
            if src.get(pos, min(len(GZIP), src.size - pos)) == GZIP:
                rows, end, onward = _member(src, pos)
            else:
                row, end = _parse(src.get, src.size, pos)
                rows = [{"kind": "record", "reason": None, **row}]
        except _Bad as e:
            if left is None:
                left = pos, [{"kind": "gap", "reason": str(e)}]
            pos = marks.after(pos + 1)
            continue
        if left is not None:
            yield from taken(*left, pos)
            left = None
        if end is None:
            left = pos, rows
            pos = marks.after(max(pos + 1, onward))
        else:
            yield from taken(pos, rows, end)
            pos = end
    if left is not None:
        yield from taken(*left, src.size)


def read_archives(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps of the archives in column ``path``, one archive at a time in a task."""

    def read(batches_in):
        for batch in batches_in:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                with open_file(path) as f:
                    for row in salvage(f):
                        row["path"] = path
                        if not with_payload:
                            row["payload"] = None
                        held.append(row)
                        size += 1000 + len(row.get("payload") or b"")
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)

    named = paths.select("path").where("path IS NOT NULL")
    return named.repartition(max(1, min(named.count(), 100_000)), "path").mapInArrow(read, ROWS)  # else few rows meet in few tasks
