"""WARC archives in which equal payloads are stored once.

Headers (page, digest, size), never payloads, are shuffled by payload digest.
The record with the largest page_id of a digest is the response; the others
become revisit records that name it. Archives are UTF-8 text files written by
Spark's text writer, one record after the other, each with a fresh header.
Reading finds records by their Content-Length and joins revisits with the
headers of their responses. Archives are compressed, and hold about ``ARCHIVE``
bytes of payload each.

Defined results: a null payload is empty; payloads of fewer than ``least``
bytes are always responses; repeated rows with the largest page_id are all
responses; a row without page_id is a response of its own, never one that
others refer to; a null url gives no WARC-Target-URI; line ends in a url are
percent-encoded; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, stored

#: Bytes of payload in one archive, on average; a record is never split.
ARCHIVE = 32 << 20
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n"
# Fixed values of the format: digits of base 32 in Java's conversion and in RFC 4648.
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base 32 of the SHA-1, 5 hexadecimal digits giving 4 of base 32."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), _DIGITS, _BASE32)


def _payloads(pages: DataFrame) -> DataFrame:
    slim = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    return slim.withColumn("digest", base32_sha1(F.encode("html", "UTF-8"))).withColumn("bytes", F.octet_length("html").cast("long"))


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    full = _payloads(pages)
    heads = stored(full.select("page_id", "digest", "bytes"))
    originals = (
        heads.where(F.col("bytes") >= least)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("response"))
        .where("n > 1")
        .select(F.col("digest").alias("d"), "response")
    )
    # Stored, so that its size is known: few revisits are broadcast and payloads stay where they are.
    revisits = stored(
        heads.join(originals, F.col("digest") == F.col("d"))
        .where("page_id <> response")
        .select(F.col("page_id").alias("p"), "d", F.col("response").alias("refers"))
        .distinct()
    )
    rows, size = heads.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    typed = full.join(revisits, (F.col("page_id") == F.col("p")) & (F.col("digest") == F.col("d")), "left")
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("refers").isNotNull()

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_END)), F.lit(""))

    head = F.concat(
        F.lit(f"WARC/1.1{_END}"),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", url),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers").cast("string"), F.lit(">"))),
        field("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        field("Content-Type", F.when(~revisit, "text/html; charset=utf-8")),
        field("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    )
    record = F.concat(head, F.lit(_END), F.when(revisit, "").otherwise(F.col("html")))
    (
        typed.select(record.alias("value"))
        .write.option("lineSep", _END * 2)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", max(1, rows * ARCHIVE // max(1, size)))
        .text(path)
    )


def parse(content: bytes) -> Iterator[dict]:
    """Records of one archive: header fields and payload bytes."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8").split(_END)
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record does not begin where it should")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        at = start + int(fields["Content-Length"])
        yield fields | {"payload": content[start:at]}
        at += 4  # the empty lines after a record


def _page(uri: str | None) -> int | None:
    return int(uri[len("<urn:page:") : -1]) if uri and uri != "<urn:page:>" else None


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and the payload of responses) of every record.

    The length of a revisit's payload is that of the response it refers to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = list(parse(gzip.decompress(content.as_py())))
                cols = [
                    pa.array([_page(r["WARC-Record-ID"]) for r in rows], pa.int64()),
                    pa.array([r.get("WARC-Target-URI") for r in rows], pa.string()),
                    pa.array([int(r["Content-Length"]) for r in rows], pa.int64()),
                    pa.array([r["WARC-Payload-Digest"].removeprefix("sha1:") for r in rows], pa.string()),
                    pa.array([r["WARC-Type"] for r in rows], pa.string()),
                    pa.array([_page(r.get("WARC-Refers-To")) for r in rows], pa.int64()),
                ]
                names = ["page_id", "url", "own_bytes", "payload_digest", "record_type", "refers_to"]
                if with_payload:
                    cols, names = [*cols, pa.array([r["payload"] for r in rows], pa.binary())], [*names, "payload"]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "page_id long, url string, own_bytes long, payload_digest string, record_type string, refers_to long"
    # Empty files have no content; they are left out before a reader meets them.
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    records = files.mapInArrow(run, schema + ", payload binary" * with_payload)
    heads = stored(records.select("page_id", "own_bytes", "payload_digest", "record_type", "refers_to")) if not with_payload else records
    sizes = (
        heads.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("own_bytes").alias("full"))
        .select(F.col("payload_digest").alias("d"), "full")
    )
    return heads.join(sizes, F.col("payload_digest") == F.col("d"), "left").select(
        "page_id",
        F.when(F.col("record_type") == "response", F.col("own_bytes")).otherwise(F.col("full")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
        *["payload"] * with_payload,
    )


def archive_digest(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes deduplicated archives of ``pages`` into the shared folder and returns what they hold per page."""
    path = shared_path(pages.sparkSession)
    write_archives(pages, path, least)
    return read_archives(pages.sparkSession, path)


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
             translate(upper(list_aggregate(list_transform(range(8), lambda i: to_base(('0x' || substr(sha1(html), (5 * i + 1)::INT, 5))::BIGINT, 32, 4)), 'string_agg', '')),
                       '{_DIGITS}', '{_BASE32}') AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS response FROM h GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = response OR page_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM h JOIN m USING (payload_digest)
"""
