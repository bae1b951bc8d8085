import io

from tonearm.llm.warc import _gzip, read_archives, record, salvage, write_pages


def _record(i, size=50):
    return record("response", f"urn:page:{i}", "http://x", f"body {i} ".encode() * size)


def _ids(rows):
    return [r.get("record_id") for r in rows]


def test_a_plain_archive_with_a_damaged_start():
    a, b, c = _record(0, 20_000), _record(1), _record(2)
    rows = list(salvage(io.BytesIO(b"XXXX" + a[4:] + b + c)))
    assert _ids(rows) == [None, "urn:page:1", "urn:page:2"] and rows[0]["length"] == len(a) > 1 << 16
    rows = list(salvage(io.BytesIO(b"\0" * (3 << 20) + a + b)))
    assert _ids(rows) == [None, "urn:page:0", "urn:page:1"] and rows[0]["length"] == 3 << 20


def test_members_and_plain_records_in_one_file():
    a, b, c = _record(0), _record(1), _record(2)
    parts = [a, _gzip(b, 6), b"junk \x1f\x8b\x08 WARC/1.0\r\n", c, _gzip(a, 6), b"\x1f\x8b"]
    rows = list(salvage(io.BytesIO(b"".join(parts))))
    assert _ids(rows) == ["urn:page:0", "urn:page:1", None, "urn:page:2", "urn:page:0", None]
    assert [r["length"] for r in rows] == [len(p) for p in parts]


def test_an_empty_member_is_a_gap():
    rows = list(salvage(io.BytesIO(_gzip(b"", 6) + _gzip(_record(0), 6))))
    assert [(r["kind"], r["reason"]) for r in rows] == [("gap", "empty member"), ("record", None)]


def test_a_member_with_several_records():
    a, b, c = _record(0), _record(1), _record(2)
    whole = _gzip(a + b.replace(b"body 1", b"bodY 1", 1) + c, 6)
    rows = list(salvage(io.BytesIO(whole + _gzip(a, 6))))
    assert _ids(rows) == ["urn:page:0", None, "urn:page:2", "urn:page:0"]
    assert [(r["offset"], r["length"]) for r in rows[:3]] == [(0, len(whole))] * 3
    assert [(r["inner_offset"], r["inner_length"]) for r in rows[:3]] == [(0, len(a)), (len(a), len(b)), (len(a) + len(b), len(c))]
    assert rows[1]["reason"] == "block digest differs" and rows[0]["reason"] is None


def test_a_cut_off_member_keeps_what_came_out():
    for level in (0, 6):
        many = [record("response", f"urn:page:{i}", "http://x", bytes((i * k * k) % 251 for k in range(3000))) for i in range(40)]
        whole = _gzip(b"".join(many), level)
        for tail in (b"", _gzip(_record(99), 6)):
            rows = list(salvage(io.BytesIO(whole[: len(whole) * 3 // 4] + tail)))
            got = [i for i in _ids(rows) if i]
            n = len(got) - bool(tail)
            assert n >= 20 and got == [f"urn:page:{i}" for i in range(n)] + ["urn:page:99"] * bool(tail)
            assert {r["length"] for r in rows if r["offset"] == 0} == {len(whole) * 3 // 4}
            assert all(r["reason"] for r in rows if r["offset"] == 0)


def test_a_member_with_a_wrong_checksum_keeps_proven_records():
    whole = bytearray(_gzip(_record(0) + _record(1).replace(b"WARC-Block-Digest", b"X-Digest") + _record(2), 6))
    whole[-6] ^= 1
    rows = list(salvage(io.BytesIO(bytes(whole) + _gzip(_record(3), 6))))
    assert _ids(rows) == ["urn:page:0", None, "urn:page:2", None, "urn:page:3"]
    assert rows[0]["reason"].startswith("bad member") and rows[1]["reason"] == "no block digest in a bad member" and rows[4]["reason"] is None


def test_headers_of_any_length(spark):
    url = "data:text/html;base64," + "QUJD" * 500_000
    pages = spark.createDataFrame([(1, url, "<p>x</p>"), (2, "http://b", "y"), (3, url, "<p>x</p>")], "page_id long, url string, html string")
    for compress in (True, False):
        rows = read_archives(write_pages(pages, compress=compress)).collect()
        assert {r.record_id: r.target_uri == url for r in rows} == {"urn:page:1": True, "urn:page:2": False, "urn:page:3": True}
        assert len(rows) == 3 and {r.kind for r in rows} == {"record"}


def test_headers_without_end():
    a = _record(1)
    rows = list(salvage(io.BytesIO(b"WARC/1.1\r\nX: " + b"x" * (3 << 20) + b"WARC/1.1\r\nX: y\r\n" * 2000 + a)))
    assert _ids(rows) == [None, "urn:page:1"]
    assert [r["kind"] for r in salvage(io.BytesIO(b"WARC/1.1\r\nX: " + b"x" * (3 << 20)))] == ["gap"]
