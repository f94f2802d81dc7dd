"""WARC: converter of legacy ARC archives.

An ARC archive opens with a version block that names its version and the fields of its header
lines; each record is one header line and as many bytes as its last field declares. Every record
becomes a WARC record with a synthesised identifier, timestamp, type and digests. Of records with equal
payloads that of the smallest key keeps its payload, the others become revisits of it.

WARC files are written through Spark's text sink, each row the records of one archive and the
line separator the end of a record, so that any file system that Spark knows can hold them;
a file holds the records of a bounded number of archives of bounded size.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutline.llm.shared import BROADCAST_ROWS, Scratch, small

# The header fields of both ARC versions, as the version block names them.
ARC_FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY = b"X-Archive-Key: "
END = b"\r\n\r\n"
#: Bytes after which an archive is closed, and archives in a WARC file.
ARC_BYTES, ARCS_A_FILE = 1 << 20, 8
#: Bytes of an archive's header line of a record, besides its URL, about.
ARC_HEADER = 80


class ArcRecord(NamedTuple):
    offset: int
    url: str
    ip: str
    date: str
    kind: str
    block: bytes
    cut: bool


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records after the version block, of either version.

    A URL may hold spaces: the other fields are split off from the right. A line that is no header is
    skipped. A record that declares more bytes than are left is returned with what there is, marked cut.
    """
    end = data.find(b"\n")
    head = data[:end].split(b" ") if end >= 0 else []
    if not head or not head[0].startswith(b"filedesc:"):
        raise ValueError("no ARC version block")
    at = end + 1 + int(head[-1])
    block = data[end + 1 : at].split(b"\n")
    names = block[1].split(b" ")
    if (version := int(block[0].split(b" ")[0])) not in ARC_FIELDS or names != ARC_FIELDS[version].split(b" "):
        raise ValueError("unknown ARC version")
    n = len(names)
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        f = data[at:end].rsplit(b" ", n - 1)
        if len(f) == n and f[-1].isdigit() and f[2].isdigit():
            size = int(f[-1])
            block_at = end + 1
            text = [x.decode("utf-8", "replace") for x in f]
            yield ArcRecord(at, text[0], text[1], text[2], text[3], data[block_at : block_at + size], block_at + size > len(data))
            at = block_at + size
        else:
            at = end + 1


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Headers with the blank line, and payload; a block without HTTP headers is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(END)
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def key_of(headers: bytes) -> int | None:
    i = headers.find(KEY)
    return int(headers[i + len(KEY) : headers.index(b"\r\n", i)]) if i >= 0 else None


def record_id(path: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{offset}')}>"


def warc_date(arc_date: str) -> str:
    """A date of up to 14 digits; what is missing is the first month, day or hour."""
    d = arc_date[:14]
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(path: str, r: ArcRecord, refers: str | None) -> bytes:
    """The WARC record of an ARC record, without the blank lines that end it."""
    headers, payload = split_http(r.block)
    block = headers if refers else r.block
    fields = [
        ("WARC-Type", "revisit" if refers else "response" if headers else "resource"),
        ("WARC-Record-ID", record_id(path, r.offset)),
        ("WARC-Target-URI", r.url),
        ("WARC-Date", warc_date(r.date)),
        ("WARC-IP-Address", r.ip),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response" if headers else r.kind),
        ("Content-Length", str(len(block))),
    ]
    fields += [("WARC-Refers-To", refers), ("WARC-Profile", REVISIT)] * bool(refers) + [("WARC-Truncated", "length")] * r.cut
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers by lower-case name, and block, by declared lengths."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.index(END, at)
        lines = data[at:end].decode().split("\r\n")[1:]
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def _clean(url: str | None) -> bytes:
    return "".join(c if c.isprintable() else "%0A" for c in url or "-").encode() or b"-"


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """(path, content) of legacy archives that hold every page as an HTTP response; versions 1 and 2 take turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        n = size = 0
        own = uuid.uuid4().hex

        def close() -> pa.RecordBatch:
            version = 1 + n % 2
            block = b"%d 0 scoutline\n%s\n\n" % (version, ARC_FIELDS[version])
            extra = b" 200 - - 0 -" if version == 2 else b""
            head = b"filedesc://a.arc 0.0.0.0 20240101000000 text/plain%s %d\n" % (extra, len(block))
            body = b"".join(b"\n%s 0.0.0.0 20240101000000 text/html%s %d\n%s" % (u, extra, len(x), x) for u, x in held)
            return pa.RecordBatch.from_arrays([pa.array([f"{own}-{n}.arc"]), pa.array([head + block + body], pa.binary())], ["path", "content"])

        for b in batches:
            ids, urls, texts = (b.column(c) for c in ("page_id", "url", "html"))
            texts = texts.cast(pa.binary())
            for i in range(b.num_rows):
                key, text = ids[i].as_py(), texts[i].as_py() or b""
                mark = b"" if key is None else KEY + b"%d\r\n" % key
                held.append((_clean(urls[i].as_py()), b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + mark + b"\r\n" + text))
                size += sum(map(len, held[-1])) + ARC_HEADER
                if size >= ARC_BYTES:
                    yield close()
                    held, size, n = [], 0, n + 1
        if held:
            yield close()

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "path string, content binary")


def arc_index(arcs: DataFrame) -> DataFrame:
    """(path, offset, key, size, digest) of every record, without its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                rows = []
                for r in parse_arc(content.as_py()):
                    headers, payload = split_http(r.block)
                    rows.append((r.offset, key_of(headers), len(payload), digest(payload)))
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.as_py()] * len(rows), pa.string()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                    ["path", "offset", "key", "size", "digest"],
                )

    return arcs.mapInArrow(run, "path string, offset long, key long, size long, digest string")


def convert(arcs: DataFrame, out: str, least: int = 0) -> None:
    """Writes the WARC records of ARC archives (path, content) to gzip files in the folder ``out``.

    Payloads of fewer than ``least`` bytes are never revisits. Of equal payloads the record of the
    smallest key is the response (a null key is the largest, ties go to path and offset). An archive
    without a version block, or of an unknown version, is an error; a cut record is written with what there is of it.
    """
    with Scratch(arcs.sparkSession) as scratch:
        index = scratch.save(arc_index(arcs))
        order = F.struct(F.col("key").isNull().alias("no"), "key", "path", "offset")
        groups = index.where(F.col("size") >= least).groupBy("digest", "size").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
        again = scratch.save(
            index.join(small(scratch.save(groups)), ["digest", "size"])
            .where("path <> first.path or offset <> first.offset")
            .groupBy("path")
            # As many as the archive has records.
            .agg(F.collect_list(F.struct("offset", F.col("first.path").alias("of"), F.col("first.offset").alias("at"))).alias("again"))
        )

        # The archives stay where they are, unless there are too many revisits to be sent to them.
        n = again.agg(F.sum(F.size("again"))).first()[0] or 0
        again = F.broadcast(again) if n <= BROADCAST_ROWS // 4 else again

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path, content, again in zip(b.column("path"), b.column("content"), b.column("again"), strict=True):
                    refers = {x["offset"]: record_id(x["of"], x["at"]) for x in again.as_py() or ()}
                    p = path.as_py()
                    text = END.join(warc_record(p, r, refers.get(r.offset)) for r in parse_arc(content.as_py()))
                    yield pa.RecordBatch.from_arrays([pa.array([text], pa.binary())], ["value"])

        (
            arcs.join(again, "path", "left")
            .select("path", "content", "again")
            .mapInArrow(run, "value binary")
            .select(F.col("value").cast("string").alias("value"))
            .write.option("lineSep", END.decode())
            .option("compression", "gzip")
            .option("maxRecordsPerFile", ARCS_A_FILE)
            .text(out)
        )


def read_warc(arcs: DataFrame) -> DataFrame:
    """(id, kind, key, size, digest, refers) of the records in WARC files (a binaryFile table); size is null for revisits.

    Bytes before, between and after records are passed over. A record without its headers' end or a declared length, and a payload that
    differs from its digest, are errors. A file without records gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows = []
                for fields, block in parse_warc(data):
                    headers, payload = split_http(block)
                    again = fields["warc-type"] == "revisit"
                    said = fields["warc-payload-digest"].removeprefix("sha1:")
                    if not again and digest(payload) != said:
                        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
                    rows.append((fields["warc-record-id"], fields["warc-type"], key_of(headers), None if again else len(payload), said, fields.get("warc-refers-to")))
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "kind", "key", "size", "digest", "refers"])

    return arcs.select("content").mapInArrow(run, "id string, kind string, key long, size long, digest string, refers string")


def archived_pages(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of pages that went through ARC and WARC.

    One row per input row. Null html is an empty payload, which is like any other. Repeated rows
    are records of their own, of which one is the response. Null page_id and url are allowed; other
    columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    with Scratch(spark) as scratch:
        arcs = scratch.save(pages_to_arc(pages))
        out = scratch.path()
        convert(arcs, out)
        got = scratch.save(read_warc(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out)))
        full = got.where("kind <> 'revisit'").select(F.col("id").alias("of"), F.col("key").alias("of_key"), F.col("size").alias("of_size"))
        rows = got.join(full, F.col("refers") == F.col("of"), "left").select(
            F.col("key").alias("page_id"),
            F.coalesce("size", "of_size").alias("payload_bytes"),
            F.col("digest").alias("payload_digest"),
            F.col("kind").alias("record_type"),
            F.col("of_key").alias("refers_to"),
        )
        return scratch.keep(rows)


#: DuckDB SQL of ``archived_pages`` where page_ids are distinct; base32 from the SHA-1 bits.
ARCHIVED_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) h FROM pages),
b AS (SELECT *, array_to_string([lpad(bin(('0x' || substr(h, 2 * i + 1, 2))::INT), 8, '0') for i in range(0, 20)], '') bits FROM p),
d AS (SELECT page_id, n, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT), 1) for i in range(0, 32)], '') dig FROM b),
f AS (SELECT *, min(page_id) OVER (PARTITION BY n, dig) first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, dig AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f
"""
