import base64
import hashlib

import pytest

from scoutline.llm.arc_to_warc import ARC_FIELDS, archived_pages, convert, parse_arc, parse_warc, read_warc, split_http, warc_date


def arc(version, *records, length=None):
    block = b"%d 0 x\n%s\n\n" % (version, ARC_FIELDS[version])
    extra = b" 200 - - 0 -" if version == 2 else b""
    out = b"filedesc://x.arc 0.0.0.0 20200102030405 text/plain%s %d\n" % (extra, len(block)) + block
    for url, body in records:
        out += b"\n%s 1.2.3.4 20200102030405 text/html%s %d\n%s" % (url, extra, len(body) if length is None else length, body)
    return out


@pytest.mark.parametrize("version", [1, 2])
def test_header_lines_of_both_versions(version):
    got = list(parse_arc(arc(version, (b"http://a/b c", b"HTTP/1.0 200 OK\r\n\r\nhi\n"), (b"http://d", b""))))
    assert [(r.url, r.ip, r.date, r.kind, r.cut) for r in got] == [("http://a/b c", "1.2.3.4", "20200102030405", "text/html", False), ("http://d", "1.2.3.4", "20200102030405", "text/html", False)]
    assert split_http(got[0].block) == (b"HTTP/1.0 200 OK\r\n\r\n", b"hi\n")


def test_cut_and_foreign_archives():
    assert [(r.block, r.cut) for r in parse_arc(arc(1, (b"http://a", b"abc"), length=9))] == [(b"abc", True)]
    for bad in (b"", b"hello\n", arc(1).replace(b"1 0 x", b"7 0 x"), arc(1).replace(b"IP-address", b"Other")):
        with pytest.raises(ValueError, match="ARC"):
            list(parse_arc(bad))
    assert warc_date("20200102") == "2020-01-02T00:00:00Z"
    assert warc_date("2020") == "2020-01-01T00:00:00Z" and warc_date("202007") == "2020-07-01T00:00:00Z" and warc_date("2020070809") == "2020-07-08T09:00:00Z"


def test_files_hold_standard_records(spark, tmp_path):
    body = b"HTTP/1.0 200 OK\r\n\r\nx\r\n\r\nWARC/1.0\r\n\r\ny"
    arcs = spark.createDataFrame([("a.arc", arc(1, (b"http://a", body), (b"http://b", body))), ("b.arc", arc(2, (b"http://c", b"no http")))], "path string, content binary")
    convert(arcs, f"{tmp_path}/w")
    rows = read_warc(spark.read.format("binaryFile").load(f"{tmp_path}/w/part-*")).collect()
    assert sorted(r.kind for r in rows) == ["resource", "response", "revisit"]
    assert {r.refers for r in rows if r.kind == "revisit"} == {r.id for r in rows if r.kind == "response"}
    import gzip

    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*")))
    blocks = {f["warc-target-uri"]: b for f, b in parse_warc(data)}
    assert blocks["http://a"] == body and blocks["http://b"] == b"HTTP/1.0 200 OK\r\n\r\n" and data.endswith(b"\r\n\r\n")


def test_pages(spark):
    rows = [(3, "http://a", "same", 1), (1, "http://b", "same", 1), (2, None, None, 1), (4, "http://c\n", "", 1), (None, "u", "é" * 9, 1), (7, "u", "x" * 3_000_000, 1), (8, "u", "r", 1), (8, "u", "r", 1)]
    got = archived_pages(spark.createDataFrame(rows, "page_id long, url string, html string, offset int")).collect()
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    seen = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    want = [(3, 4, sha("same"), "revisit", 1), (1, 4, sha("same"), "response", None), (2, 0, sha(""), "response", None), (4, 0, sha(""), "revisit", 2), (-1, 18, sha("é" * 9), "response", None), (7, 3_000_000, sha("x" * 3_000_000), "response", None), (8, 1, sha("r"), "response", None), (8, 1, sha("r"), "revisit", 8)]
    assert seen == sorted(want, key=lambda x: (*x[:4], x[4] or 0))
    assert archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
