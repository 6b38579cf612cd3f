r"""WARC archives with resolved revisits.

``plan`` shuffles headers (no payloads) by payload digest: of records with
equal payloads of ``min_bytes`` or more, the one with the largest id is the
response and the others revisit it.  ``write_archives`` writes gzipped WARC
1.1 files with fresh headers through Spark's text writer, so any store that
Spark writes will do: a record is UTF-8 text, and the two line ends that
close a record are the writer's line separator.  ``read_archives`` parses
whole files by Content-Length and checks every response's digest.

Defined results: a null payload is empty and takes part; rows of a null id
revisit the largest id of their payload, or are responses if there is none;
rows that repeat the largest id are responses each, and rows of one id and
payload, which are one capture, have one record id; a null or odd URL is
written as ``urn:page:<id>`` or with its white space and control characters
percent-encoded; no rows give an archive without records.  Only id, url and
payload are read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import drop_path, scratch_path, written

END = "\r\n"
RECORD_END = END + END
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "page_id long, url string, record_id string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload string"
)


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of the text's UTF-8: eight groups of 20 bits."""
    digest = F.sha1(text.cast("binary"))
    groups = [
        F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", page_id.cast("string"), digest))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def plan(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Per (page_id, payload_digest): payload_bytes, record_type, refers_to and its URL."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    headers = written(
        pages.select(F.col("page_id").cast("long"), _target(F.col("page_id")).alias("target"), F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest")),
        "headers",
    )
    origins = headers.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max(F.struct("page_id", "target")).alias("o")).select(
        "payload_digest", F.col("o.page_id").alias("origin"), F.col("o.target").alias("origin_target"))
    joined = headers.join(origins, "payload_digest", "left")
    revisit = F.col("origin").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("origin"))
    return joined.select(
        "page_id", "payload_digest", "payload_bytes",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("origin")).alias("refers_to"), F.when(revisit, F.col("origin_target")).alias("refers_to_target"),
    ).distinct()


def _target(page_id: Column) -> Column:
    """The URL of a page as a header can hold it."""
    named = F.coalesce(F.col("url"), F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none"))))
    return F.regexp_replace(named, r"[\x00-\x20\x7F]", "%20")


def write_archives(
    pages: DataFrame, path: str, *, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 16 << 20
) -> None:
    """One record per row of ``pages`` under ``path``, in files of about ``file_bytes`` before compression."""
    planned = plan(pages, min_bytes=min_bytes)
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("id"), "url", payload.alias("payload"), base32_sha1(payload).alias("digest"))
    joined = rows.join(planned, rows["id"].eqNullSafe(planned["page_id"]) & (rows["digest"] == planned["payload_digest"]))
    size = planned.agg(F.avg("payload_bytes")).first()[0] or 0
    response = F.col("record_type") == "response"
    http = F.concat(F.lit(HTTP), F.col("payload_bytes"), F.lit(RECORD_END))
    block = F.when(response, F.concat(http, F.col("payload"))).otherwise(http)
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <"), _record_id(F.col("id"), F.col("digest")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _target(F.col("id"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(~response, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: <"), _record_id(F.col("refers_to"), F.col("digest")), F.lit(">"))),
        F.when(~response, F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.col("refers_to_target"))),
        F.when(~response, F.lit(f"WARC-Refers-To-Date: {date}")),
        F.when(~response, F.concat(F.lit("X-Refers-To-Page: "), F.col("refers_to"))),
        F.concat(F.lit("X-Page: "), F.col("id")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block")),
    ]
    joined.withColumn("block", block).select(F.concat(F.concat_ws(END, *lines), F.lit(RECORD_END), F.col("block"))).write.options(
        lineSep=RECORD_END, compression="gzip", maxRecordsPerFile=max(1, int(file_bytes // (size + 600)))
    ).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:head].decode().split(END)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        start = head + 4
        end = start + int(headers["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has another length than it says")
        yield headers, data[start:end]
        at = end + 4


def _unzipped(data: bytes) -> bytes:
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64() if x.split()[1] == "long" else pa.string() for x in RECORD.split(", ")]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for headers, block in parse(_unzipped(content.as_py())):
                whole = headers["WARC-Type"] == "response"
                payload = block[block.index(b"\r\n\r\n") + 4 :] if whole else None
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if whole and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"the payload of {headers['WARC-Record-ID']} is damaged")
                page, origin = headers.get("X-Page"), headers.get("X-Refers-To-Page")
                rows.append((
                    int(page) if page else None, headers["WARC-Target-URI"], headers["WARC-Record-ID"][1:-1], headers["WARC-Type"],
                    int(origin) if origin else None, len(payload) if whole else int(headers["X-Payload-Length"]), digest,
                    payload.decode() if whole and payloads else None,
                ))
            for i in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 1000]), kinds)], names=names)


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """Per record: RECORD; a revisit's payload is null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(lambda batches: _read(batches, payloads), RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """The records with each revisit's payload taken from the response it refers to."""
    responses = records.where(F.col("record_type") == "response").select(
        F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload").alias("__original")
    ).dropDuplicates(["refers_to", "payload_digest"])
    out = records.join(responses, ["refers_to", "payload_digest"], "left")
    return out.withColumn("payload", F.coalesce("payload", "__original")).select(*records.columns)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the archives to the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, **options)
    out = written(read_archives(spark, path, payloads=False), "records")
    drop_path(spark, path)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
