"""WARC archives: write pages as segmented, chunk-framed records, and read them back whole.

Writing. Each page is one record; its HTTP block carries the html in chunked transfer framing. A block longer
than ``segment_bytes`` is cut: the first part is the record itself (WARC-Segment-Number 1), the others are
continuation records that name the first by WARC-Segment-Origin-ID, and the last one states the total length.
Among pages with equal payloads, the one with the smallest page_id is a response and the others are revisit
records without a payload. The records are strings that Spark's text sink writes with CRLF as line end, so the
files are plain WARC in gzip and land wherever Spark can write.

Reading. Files are cut into records by Content-Length. Segments meet by origin id, are ordered by number, and
must be complete: numbers 1 .. n and the stated total length. Then the chunk framing is taken off.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, table, written

HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: Bytes of a file before compression, and of a record's header, that bound the records of a file.
FILE_BYTES, HEADER_BYTES = 256 << 20, 2048
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(hex40: Column) -> Column:
    """Base32 of a 160-bit digest given as 40 hexadecimal digits: five digits make four symbols."""
    parts = []
    for i in range(0, 40, 5):
        v = F.conv(F.substring(hex40, i + 1, 5), 16, 10).cast("int")
        parts += [F.substr(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _pieces(data: Column, size: int, make) -> Column:
    """``make(piece, i)`` over the pieces of ``size`` bytes of a binary column, as an array; none for no bytes."""
    n = F.ceil(F.octet_length(data) / F.lit(size)).cast("int")
    cut = lambda i: F.substring(data, i * size + 1, F.lit(size))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: make(cut(i), i))).otherwise(F.array().cast("array<string>"))


def write_warc(pages: DataFrame, path: str, segment_bytes: int = 16384, chunk_bytes: int = 4096, revisit_from: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to gzip WARC files under ``path``.

    Records are no longer than a segment and its header, so their number bounds a file by ``file_bytes`` before
    compression; the text sink writes one gzip stream a file. A url with control characters, or white space at its
    ends, goes along in hexadecimal as well, so that it reads back unchanged.

    Payloads of ``revisit_from`` bytes or more are stored once. A null html is an empty payload; a null page_id
    gets no page header and reads back as null. Repeated rows give a record each.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html"))
    twins = p.filter(F.col("n") >= revisit_from).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("c"))
    # Written first, so that its true size decides between a broadcast and a shuffle of the pages.
    twins = written(twins.filter("c > 1").drop("c"), "twins")
    p = p.join(twins, "sha", "left").withColumn("again", F.coalesce(F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id")), F.lit(False)))
    chunk = lambda piece, i: F.concat(F.lower(F.hex(F.octet_length(piece).cast("long"))), F.lit("\r\n"), piece.cast("string"), F.lit("\r\n"))
    body = F.concat(F.lit(HTTP_HEAD), F.array_join(_pieces(F.col("html").cast("binary"), chunk_bytes, chunk), ""), F.lit("0\r\n\r\n"))
    p = p.withColumn("block", F.when(F.col("again"), F.lit(HTTP_HEAD)).otherwise(body).cast("binary"))
    h = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "sha", F.monotonically_increasing_id().cast("string")).cast("binary"))
    uid = F.concat(*[x for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.lit("-"), F.substring(h, a, b))][1:])
    p = p.withColumn("uid", uid).withColumn("digest", base32_of_hex(F.col("sha")))
    p = p.select("*", F.posexplode(_pieces(F.col("block"), segment_bytes, lambda piece, i: piece.cast("string"))).alias("seg", "part"))
    size, segments = F.octet_length("block"), F.ceil(F.octet_length("block") / F.lit(segment_bytes))
    line = lambda name, value, when=None: F.when(F.lit(True) if when is None else when, F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))
    head, own = F.col("seg") == 0, F.concat(F.lit("<urn:uuid:"), F.col("uid"), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(~head, F.lit("continuation")).when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.when(head, own).otherwise(F.concat(F.lit("<urn:uuid:"), F.col("uid"), F.lit("#"), F.col("seg").cast("string"), F.lit(">")))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "%0A"), head & F.col("url").isNotNull()),
        line("X-Target-URI-Hex", F.hex(F.col("url").cast("binary")), head & F.col("url").rlike(r"(?U)\p{Cntrl}|^\s|\s$")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")), head),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), head & F.col("again")),
        line("X-Page-ID", F.col("page_id"), head & F.col("page_id").isNotNull()),
        line("X-Refers-To-Page-ID", F.coalesce("first_id", F.lit(0)), head & F.col("again")),
        line("WARC-Segment-Number", F.col("seg") + 1, segments > 1),
        line("WARC-Segment-Origin-ID", own, ~head),
        line("WARC-Segment-Total-Length", size, (segments > 1) & (F.col("seg") + 1 == segments)),
        F.when(head, F.lit("Content-Type: application/http;msgtype=response\r\n")).otherwise(F.lit("")),
        line("Content-Length", F.octet_length("part")),
        F.lit("\r\n"),
        F.col("part"),
        F.lit("\r\n"),
    )
    p.select(record.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, file_bytes // (segment_bytes + HEADER_BYTES))).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of one gzip or plain WARC file."""
    f = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    f = io.BufferedReader(f, 1 << 18)  # type: ignore[arg-type]
    while line := f.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        n = int(fields["content-length"])
        block = f.read(n)
        if len(block) != n:
            raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
        yield fields, block


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP response block; chunked transfer framing is taken off."""
    at = block.find(b"\r\n\r\n")
    if at < 0:
        raise ValueError("no HTTP header")
    head, body = block[:at].lower(), block[at + 4 :]
    if b"\r\ntransfer-encoding: chunked" not in head:
        return body
    out, i = [], 0
    while True:
        j = body.index(b"\r\n", i)
        n = int(body[i:j].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(body[j + 2 : j + 2 + n])
        i = j + 4 + n
        if len(out[-1]) != n or body[i - 2 : i] != b"\r\n":
            raise ValueError("a chunk is cut short")


_SCHEMA = "origin string, segment int, total_length long, warc_type string, page_id long, refers_to long, url string, block binary, payload binary, payload_bytes long, payload_digest string"
_ARROW = pa.schema(
    [("origin", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()), ("warc_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("url", pa.string()), ("block", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _decoded(row: dict, block: bytes, keep: bool) -> None:
    if row["warc_type"] == "response":
        payload = http_payload(block)
        row["payload_bytes"], row["payload_digest"] = len(payload), _digest(payload)
        row["payload"] = payload if keep else None


def _reader(keep: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows, held = [], 0
                for f, block in parse_records(data.as_py()):
                    num = lambda k, f=f: int(f[k]) if k in f else None
                    row = {n: None for n in _ARROW.names}
                    kind = f.get("warc-type", "")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    row |= {"origin": f.get("warc-segment-origin-id") or f.get("warc-record-id"), "segment": num("warc-segment-number"), "total_length": num("warc-segment-total-length"), "warc_type": kind}
                    row |= {"page_id": num("x-page-id"), "refers_to": num("x-refers-to-page-id"), "url": bytes.fromhex(f["x-target-uri-hex"]).decode() if "x-target-uri-hex" in f else f.get("warc-target-uri"), "payload_digest": f.get("warc-payload-digest", "").removeprefix("sha1:") or None}
                    if row["segment"] is None:
                        _decoded(row, block, keep)
                    else:
                        row["block"] = block
                    rows.append(row)
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return read


def _joiner(keep: bool):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                parts = r.pop("parts")
                block = b"".join(p["block"] for p in parts)
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or r["total_length"] != len(block):
                    raise ValueError(f"record {r['origin']}: segments are missing, or the total length is not {len(block)}")
                row = {n: None for n in _ARROW.names} | r
                _decoded(row, block, keep)
                yield pa.RecordBatch.from_pylist([row], _ARROW)

    return join


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per response or revisit record under ``path``, put together from its segments.

    A record whose segments are not all there, or whose total length is not the stated one, is an error. Only
    segmented records are shuffled; the others are decoded where they are read. ``payloads=False`` leaves the
    payload column null and keeps length and digest.
    """
    raw = written(spark.read.format("binaryFile").load(path).select("content").mapInArrow(_reader(payloads), _SCHEMA), "records")
    whole = raw.filter("segment IS NULL")
    head = lambda c: F.max(c).alias(c)
    parts = (
        raw.filter("segment IS NOT NULL")
        .groupBy("origin")
        .agg(F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"), head("total_length"), F.max(F.when(F.col("segment") == 1, F.col("warc_type"))).alias("warc_type"), head("page_id"), head("refers_to"), head("url"))
        .mapInArrow(_joiner(payloads), _SCHEMA)
    )
    return whole.unionByName(parts).drop("block", "segment", "total_length", "origin")


def warc_round_trip(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back, and describe each page's record.

    ``payload_bytes`` and ``payload_digest`` of a revisit are those of the response with its digest.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(pages, path, revisit_from=revisit_from)
    back = read_warc(spark, path, payloads=False)
    stored = back.filter("warc_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("stored_bytes"))
    out = back.filter("warc_type = 'response'").select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "url")
    again = back.filter("warc_type = 'revisit'").join(stored, "payload_digest").select("page_id", F.col("stored_bytes").alias("payload_bytes"), "payload_digest", F.lit("revisit").alias("record_type"), "refers_to", "url")
    return out.unionByName(again)


def op1(spark, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


ORACLE_OP1 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS f FROM p),
b AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(sha, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS v FROM d)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((x >> s) & 31) + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to,
  url
FROM b
"""
