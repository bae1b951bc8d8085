"""Media folders and containers: the walk, formats, tags, chapters, 1-bit audio files."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.functions.names import book_dir
from tonearm.functions.text import format_of


def walked(spark: SparkSession, root: str, skip: list[str] | None = None, content: bool = False) -> DataFrame:
    """(path, size, mtime, format[, content]) of audio files below a root, other files and skipped roots left out.

    Without ``content`` only the listing is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), format_of(F.col("path")).alias("format"), *(["content"] if content else []))
    for s in skip or []:
        rows = rows.where(~F.contains("path", F.lit(s.rstrip("/") + "/")))
    return rows.where("format IS NOT NULL")


def books_of(files: DataFrame) -> DataFrame:
    """Files grouped by the directory that stands for their book."""
    return files.groupBy(book_dir(F.col("path")).alias("book_dir")).agg(F.array_sort(F.collect_list("path")).alias("paths"), F.sum("size").alias("size"))


def mp4_chapters(data: bytes) -> list[tuple[int, str]]:
    """(start in ms, title) of the chapter list of an MP4 file; none where it is absent or broken."""

    def boxes(lo, hi):
        while lo + 8 <= hi:
            size, kind = struct.unpack_from(">I4s", data, lo)
            head = 8
            if size == 1 and lo + 16 <= hi:
                size, head = struct.unpack_from(">Q", data, lo + 8)[0], 16
            size = size or hi - lo
            if size < head or lo + size > hi:
                return
            yield kind, lo + head, lo + size
            lo += size

    def inside(span, want):
        return next(((a, b) for k, a, b in boxes(*span) if k == want), None)

    at = (0, len(data))
    for name in (b"moov", b"udta", b"chpl"):
        at = inside(at, name)
        if at is None:
            return []
    lo, hi = at
    out, p = [], lo + (9 if data[lo : lo + 1] == b"\x01" else 5)
    if p > hi or p - 1 < lo:
        return []
    count = data[p - 1]
    for _ in range(count):
        if p + 9 > hi:
            break
        start, n = struct.unpack_from(">QB", data, p)
        if p + 9 + n > hi:
            break
        out.append((start // 10_000, data[p + 9 : p + 9 + n].decode("utf-8", "replace")))
        p += 9 + n
    return out


def dsf_header(data: bytes) -> dict | None:
    """Rates, length and where the audio and the tag lie in a DSF file (bits least significant first)."""
    if data[:4] != b"DSD " or data[28:32] != b"fmt " or len(data) < 80:
        return None
    tag, = struct.unpack_from("<Q", data, 20)
    size, _, _, _, channels, rate, bits, samples, block = struct.unpack_from("<QIIIIIIQI", data, 32)
    start = 28 + size
    if data[start : start + 4] != b"data":
        return None
    return {"container": "dsf", "channels": channels, "sample_rate": rate, "samples": samples, "block": block, "lsb_first": bits == 1, "audio_at": start + 12, "tag_at": tag or None}


def dff_header(data: bytes) -> dict | None:
    """The same for a DFF file (most significant bit first)."""
    if data[:4] != b"FRM8" or data[12:16] != b"DSD ":
        return None
    out: dict = {"container": "dff", "lsb_first": False, "block": 1, "tag_at": None}
    at, n = 16, len(data)
    while at + 12 <= n:
        kind, size = struct.unpack_from(">4sQ", data, at)
        body = at + 12
        if kind == b"PROP":
            p, end = body + 4, min(n, body + size)
            while p + 12 <= end:
                k, m = struct.unpack_from(">4sQ", data, p)
                if k == b"FS  ":
                    out["sample_rate"] = struct.unpack_from(">I", data, p + 12)[0]
                elif k == b"CHNL":
                    out["channels"] = struct.unpack_from(">H", data, p + 12)[0]
                p += 12 + m + (m & 1)
        elif kind == b"DSD ":
            out["audio_at"], out["samples"] = body, size * 8 // max(1, out.get("channels", 1))
        elif kind == b"ID3 ":
            out["tag_at"] = body
        at = body + size + (size & 1)
    return out if {"sample_rate", "channels", "audio_at"} <= out.keys() else None


def id3_text(data: bytes) -> dict[str, str]:
    """Text frames of an ID3v2 tag (versions 2.3 and 2.4)."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}
    safe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end, at, out = min(len(data), 10 + safe(data[6:10])), 10, {}
    while at + 10 <= end and data[at : at + 1].isalnum():
        name = data[at : at + 4].decode("latin-1")
        size = safe(data[at + 4 : at + 8]) if data[3] == 4 else struct.unpack_from(">I", data, at + 4)[0]
        body = data[at + 10 : at + 10 + size]
        if name.startswith("T") and name != "TXXX" and body:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            out[name] = body[1:].decode(code, "replace").split("\0")[0].strip()
        at += 10 + size
    return out


TAGS = "path string, container string, channels int, sample_rate long, duration_ms long, title string, artist string, album string, chapters array<struct<start_ms:long,title:string>>"


def tagged(files: DataFrame) -> DataFrame:
    """Details read from file bytes (path, content): 1-bit containers, their tags, and MP4 chapters."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                data = bytes(data or b"")
                h = dsf_header(data) or dff_header(data) or {}
                t = id3_text(data[h["tag_at"] :]) if h.get("tag_at") else id3_text(data)
                ms = int(h["samples"] * 1000 // h["sample_rate"]) if h.get("samples") and h.get("sample_rate") else None
                rows.append((path, h.get("container"), h.get("channels"), h.get("sample_rate"), ms, t.get("TIT2"), t.get("TPE1"), t.get("TALB"), [{"start_ms": a, "title": b} for a, b in mp4_chapters(data)]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TAGS.split(", ")]).astype({"channels": "Int32", "sample_rate": "Int64", "duration_ms": "Int64"})

    return files.select("path", "content").mapInPandas(run, TAGS)


def untagged(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose tags were never read: only these are opened by a backfill."""
    return files.join(known.where("NOT checked").select("path"), "path", "left_semi")
