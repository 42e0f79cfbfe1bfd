"""WARC archives: written by Spark's text writer, read back by record length, assembled into captures.

A record is its headers, a block and two line ends, and that end is the writer's line separator, so
each output file is a WARC file on whatever file system holds it. A capture is a request, a response (or a revisit, where a
page of smaller id has the same payload) and a metadata record; the request and the metadata name the
response in WARC-Concurrent-To. Reading parses every file by Content-Length alone; assembly joins the
three kinds of record through these identifiers into one nested row a capture.

Defined results: null html is an empty payload; payloads under min_bytes are never revisits; of pages with one
payload the smallest id is the response and rows that repeat that id are responses too; null ids come
after all others and revisit; ids are whole numbers; repeated rows are captures of their own; urls may hold anything; payloads of any
length are whole records; other columns are ignored, whatever their names; no pages give no captures.
"""

from __future__ import annotations

import gzip
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm.common import arrow_batches, skewed_join, stash, table, work_path

#: Bytes and records that a file is meant to hold; a reader takes one file at a time, compressed, and one record of it.
FILE_BYTES, FILE_RECORDS = 64 << 20, 6000
#: Bytes a record's headers may have.
HEAD = 1 << 20
DATE = "2026-01-01T00:00:00Z"
LF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: twenty bits, five hex digits, at a time."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(kind: str) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.col("_row").cast("string"), F.col("_digest")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: Column | str, urn: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), urn), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]  # a null value drops its line
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(LF, *lines), F.lit(LF + LF), block)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> None:
    """Three records a row, gzip files under path."""
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("_url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("_html")
    ).withColumn("_digest", base32_sha1(F.col("_html").cast("binary")))
    size = F.octet_length("_html")
    first = stash(
        rows.filter(size >= min_bytes).groupBy("_digest").agg(F.min("_id").alias("_first"), F.min_by("_url", "_id").alias("_first_url"), F.count(F.lit(1)).alias("_rows"), F.max(size).alias("_size")), "payloads"
    )
    total, bytes_ = first.agg(F.sum("_rows"), F.sum("_size")).first()  # a revisit has no payload
    fit = max(3, min(FILE_RECORDS, int(FILE_BYTES * 3 * (total or 1) // ((bytes_ or 0) + 1500 * (total or 1)))))
    rows = skewed_join(rows, first, ["_digest"], "_rows", "_id").withColumn("_row", F.monotonically_increasing_id())
    again = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    safe = lambda url: F.regexp_replace(url, r"[\x00-\x20\x7F]", "_")  # noqa: E731  headers are lines; the exact url is in the metadata
    target = ("WARC-Target-URI", safe(F.col("_url")))
    response, payload = _urn("response"), F.when(~again, F.col("_html")).otherwise("")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(LF + LF))
    link = ("WARC-Concurrent-To", response)
    host, where = F.regexp_extract(safe(F.col("_url")), r"^[a-zA-Z]+://([^/?#]*)", 1), F.regexp_extract(safe(F.col("_url")), r"^[a-zA-Z]+://[^/?#]*(.*)$", 1)
    records = F.array(
        _record("request", _urn("request"), [target, link, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET /"), F.regexp_replace(where, "^/", ""), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(LF + LF))),
        _record(
            F.when(again, "revisit").otherwise("response"),
            response,
            [
                target,
                ("Content-Type", F.lit("application/http; msgtype=response")),
                ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
                ("WARC-Profile", F.when(again, PROFILE)),
                ("WARC-Refers-To-Target-URI", F.when(again, safe(F.col("_first_url")))),
                ("WARC-Refers-To-Date", F.when(again, DATE)),
            ],
            F.concat(http, payload),
        ),
        _record(
            "metadata",
            _urn("metadata"),
            [target, link, ("Content-Type", F.lit("application/warc-fields"))],
            F.concat(
                F.concat_ws(
                    LF,
                    F.concat(F.lit("page-id: "), F.col("_id").cast("string")),
                    F.concat(F.lit("url: "), F.url_encode("_url")),
                    F.concat(F.lit("payload-length: "), size.cast("string")),
                    F.when(again, F.concat(F.lit("refers-to-page: "), F.col("_first").cast("string"))),
                ),
                F.lit(LF),
            ),
        ),
    )
    lines = rows.select(F.explode(records).alias("value"))
    lines.write.option("lineSep", LF + LF).option("compression", "gzip").option("maxRecordsPerFile", fit).text(path)


class Buffer:
    """What has been read of a stream and not yet been taken."""

    def __init__(self, stream):
        self.stream, self.data = stream, bytearray()

    def fill(self, n: int) -> bool:
        """Whether n bytes are there."""
        while len(self.data) < n:
            more = self.stream.read(max(1 << 16, n - len(self.data)))
            if not more:
                return False
            self.data += more
        return True

    def find(self, mark: bytes, at: int, most: int) -> int:
        """Where a mark begins in the first `most` bytes, or -1."""
        while (k := self.data.find(mark, at, most)) < 0 and len(self.data) < most:
            at = max(at, len(self.data) - len(mark) + 1)
            if not self.fill(len(self.data) + 1):
                break
        return k

    def skip(self, mark: bytes) -> int:
        """Drops all before the next mark behind the first byte, or the rest; how many bytes that were."""
        gone = 0
        while True:
            k = self.data.find(mark, 0 if gone else 1)
            if k >= 0:
                del self.data[:k]
                return gone + k
            keep = len(mark) - 1
            drop = max(0, len(self.data) - keep)
            gone += drop
            del self.data[:drop]
            if not self.fill(len(self.data) + 1):
                gone += len(self.data)
                self.data.clear()
                return gone


def parse(stream):
    """Records of a WARC stream in order: headers with lower-case names, and the block. What is no whole record counts as one of type
    `broken`, whose block is empty and whose content-length is what was passed over; reading goes on at the next line that begins with WARC/."""
    b = Buffer(stream)
    while b.fill(1):
        b.fill(5)
        end, n, head = (b.find(b"\r\n\r\n", 0, HEAD) if b.data.startswith(b"WARC/") else -1), None, {}
        if end >= 0:
            for line in bytes(b.data[:end]).split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                head[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
            size = head.get("content-length", "")
            n = int(size) if size.isascii() and size.isdigit() else None
        if n is None or "warc-type" not in head or not b.fill(end + 8 + n) or b.data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            yield {"warc-type": "broken", "content-length": str(b.skip(b"\nWARC/"))}, b""
            if b.data:
                del b.data[:1]
            continue
        block = bytes(b.data[end + 4 : end + 4 + n])
        del b.data[: end + 8 + n]
        yield head, block


RECORD = "type string, record_id string, concurrent_to string, target_uri string, block_bytes long, payload_bytes long, payload_digest string, page_id long, url string, refers_to long, payload binary"


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row a record of every file under path. A response whose payload does not have the digest in its header, or a record without the
    headers of its type, is a row of type `broken` like the bytes of no record, so one bad record does not cost the others."""
    arrow_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def go(batches):
        import base64
        import hashlib
        from urllib.parse import unquote_plus

        import pyarrow as pa

        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORD.split(", ")])

        def row(head, block):
            out = dict.fromkeys(names) | {"type": head["warc-type"], "record_id": head.get("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to"), "target_uri": head.get("warc-target-uri"), "block_bytes": len(block)}
            if head["warc-type"] == "broken":
                return out | {"block_bytes": int(head["content-length"])}
            if head["warc-type"] in ("response", "revisit"):
                out["payload_digest"] = head.get("warc-payload-digest", "").removeprefix("sha1:")
                if head["warc-type"] == "response":
                    body = block.partition(b"\r\n\r\n")[2]
                    if base64.b32encode(hashlib.sha1(body).digest()).decode() != out["payload_digest"]:
                        return out | {"type": "broken"}
                    out["payload_bytes"] = len(body)
                    out["payload"] = body if payloads else None
            elif head["warc-type"] == "metadata":
                own = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n") if ": " in x)
                number = lambda k: int(own[k]) if re.fullmatch("-?[0-9]{1,18}|-?[0-9]{19}", own.get(k, "")) and -(2**63) <= int(own[k]) < 2**63 else None
                out |= {"page_id": number("page-id"), "payload_bytes": number("payload-length"), "refers_to": number("refers-to-page")}
                out["url"] = unquote_plus(own.get("url", ""))
            return out

        for b in batches:
            for content in b.column(0):
                data, rows, size = io.BytesIO(content.as_py()), [], 0
                stream = gzip.GzipFile(fileobj=data) if data.getbuffer()[:2] == b"\x1f\x8b" else data
                for head, block in parse(stream):
                    rows.append(row(head, block))
                    size += len(block) if payloads else 0
                    if len(rows) >= 2048 or size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(go, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row a response or revisit: page_id, url, response, request, metadata; what is missing is null."""
    response = records.filter(F.col("type").isin("response", "revisit")).select("record_id", F.struct("record_id", "type", "target_uri", "block_bytes", "payload_bytes", "payload_digest", "payload").alias("response"))
    request = records.filter("type = 'request'").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), "target_uri", "block_bytes").alias("request"))
    metadata = records.filter("type = 'metadata'").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), "page_id", "url", "payload_bytes", "refers_to").alias("metadata"))
    joined = response.join(request, "record_id", "left").join(metadata, "record_id", "left")
    return joined.select("metadata.page_id", "metadata.url", "response", "request", "metadata")


def op10_warc(spark, sf_dir):
    path = work_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    found = captures(stash(read_warc(spark, path).drop("payload").withColumn("payload", F.lit(None).cast("binary")), "records"))
    return found.select(
        "page_id",
        F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        "response.payload_digest",
        F.col("response.type").alias("record_type"),
        "metadata.refers_to",
    )


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
