import base64
import hashlib
import io
import zlib

from tonearm.llm.warc import _gzip, read_archives, record, salvage, write_pages


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type string, sha int")


def test_round_trip_nulls_ties_and_clashing_columns(spark):
    rows = [(1, "http://a", "<p>x</p>", "z", 1), (2, None, "<p>x</p>", None, 2), (3, "u v", None, None, None), (4, "u", "", None, 1), (5, "u", "é" * 100_000, None, 1), (None, "u", "<p>x</p>", None, 1), (2, "u", "<p>x</p>", None, 1)]
    got = read_archives(write_pages(_pages(spark, rows))).where("kind = 'record'").collect()
    assert len(got) == len(rows)
    key = sorted((r.record_id if r.record_id.startswith("urn:page") else "-", r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got)
    want = []
    for page, _, html, *_ in rows:
        body = (html or "").encode()
        best = max(p for p, _, h, *_ in rows if p is not None and (h or "") == (html or ""))
        again = page is None or page < best
        want.append((f"urn:page:{page}" if page is not None else "-", "revisit" if again else "response", f"urn:page:{best}" if again else None, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()))
    assert sorted(want, key=str) == sorted(key, key=str)
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == {(h or "").encode() for _, _, h, *_ in rows}


def test_empty_table(spark):
    assert read_archives(write_pages(_pages(spark, []))).count() == 0


def _three():
    return [record("response", f"urn:page:{i}", "http://x", f"body {i} WARC/1.0\r\nx".encode() * 50) for i in range(3)]


def test_salvage_of_broken_members():
    parts = [_gzip(r, 6) for r in _three()]
    bad = bytearray(parts[1])
    bad[len(bad) // 2] ^= 0xFF
    rows = list(salvage(io.BytesIO(parts[0] + bytes(bad) + parts[2] + parts[0][:40])))
    assert [r["kind"] for r in rows] == ["record", "gap", "record", "gap"]
    assert (rows[1]["offset"], rows[1]["length"]) == (len(parts[0]), len(bad))
    assert rows[2]["record_id"] == "urn:page:2" and rows[3]["length"] == 40
    assert sum(r["length"] for r in rows) == len(parts[0]) + len(bad) + len(parts[2]) + 40


def test_salvage_of_plain_records():
    a, b, c = _three()
    broken = b.replace(b"body 1", b"bodY 1", 1)
    rows = list(salvage(io.BytesIO(b"junk" + a + broken + c)))
    assert [r["kind"] for r in rows] == ["gap", "record", "gap", "record"]
    assert rows[2]["length"] == len(broken) and rows[2]["reason"] == "block digest differs"
    short = b.replace(b"Content-Length: ", b"Content-Length: 9", 2)
    rows = list(salvage(io.BytesIO(a + short + c)))
    assert [r.get("record_id") for r in rows] == ["urn:page:0", None, "urn:page:2"]


def test_salvage_of_junk():
    assert [r["kind"] for r in salvage(io.BytesIO(b"\x1f\x8b\x08" + b"x" * 3_000_000))] == ["gap"]
    assert list(salvage(io.BytesIO(b""))) == []
    assert zlib.decompress(_gzip(b"a", 1), 31) == b"a"


def test_many_repeated_payloads_are_joined_by_a_shuffle(spark, monkeypatch):
    from tonearm.llm import warc

    rows = [(i, f"http://x/{i}", "" if i % 3 == 0 else None if i % 7 == 0 else f"<p>{i % 40}</p>", "k", 1) for i in range(300)]
    want = sorted((r.record_id, r.record_type, r.refers_to or "", r.payload_digest) for r in read_archives(write_pages(_pages(spark, rows))).collect())
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    got = sorted((r.record_id, r.record_type, r.refers_to or "", r.payload_digest) for r in read_archives(write_pages(_pages(spark, rows))).collect())
    assert got == want and len(got) == 300
