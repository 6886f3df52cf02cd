"""Operator 9: a content-addressed WARC archive.

Three tables make the archive. ``payloads`` holds the bytes of every different payload once, under its SHA-256;
``records`` holds one row per record: its WARC header block exactly as it stands in the archive, the HTTP header
block of a response, and the address of its payload. ``archive_records`` joins them back to the original records,
byte for byte. A payload is verified against its address when stored and when read.

Of the records whose payloads are equal and at least ``revisit_bytes`` long, the one with the largest page_id is a
response, the others are revisits of it; shorter payloads always make responses.

Rows: null html is an empty payload; rows with equal page_ids are kept (of those with the largest page_id of their
payload all are responses); a null page_id counts as smallest. An empty table gives an empty archive. Other columns
are ignored; a null url leaves the header field out. Control characters of a url are percent-encoded in the header;
``records`` keeps the url as it came in a column of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import Workspace, lean, table

REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def _record_header(kind: Column, page: Column, url: Column, sha1: Column, length: Column, target: Column) -> Column:
    """The WARC header block. A revisit names the record it refers to; block length counts the HTTP header and, in a response, the payload."""
    http = F.length(_http_header(length)).cast("long")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    return F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), name(page)),
        F.concat(F.lit("WARC-Target-URI: "), _in_one_line(url)),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1),
        F.when(kind == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: "), name(target))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.when(kind == "revisit", http).otherwise(http + length).cast("string")),
        F.lit(CRLF),
    )


def _in_one_line(url: Column) -> Column:
    """url with its control characters percent-encoded, so that it can neither end the field nor begin another."""
    control = r"[\x00-\x1F\x7F]"
    escaped = F.concat_ws("", F.transform(F.split(url, ""), lambda c: F.when(c.rlike(control), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)))
    return F.when(url.rlike(control), escaped).otherwise(url)


def _http_header(length: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length.cast("string"), F.lit(CRLF + CRLF))


def write_archive(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write pages(page_id, url, html) as an archive below ``path``.

    One exchange gathers the payloads: the first aggregation keeps one copy of equal bytes in each task before the
    shuffle, so a payload shared by many pages does not travel once for each. That equal addresses mean equal payloads
    is checked by their lengths and a second digest. Records of payloads long enough for revisits are joined to their
    payload's largest page_id on the 32-byte address alone; the shorter ones, however many share one, meet no join.
    """
    read = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha256", F.sha2("payload", 256))
    facts = read.select("page_id", "url", "sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    mark = F.concat_ws(":", F.octet_length("payload").cast("string"), F.sha1("payload"))
    store = (
        read.groupBy("sha256")
        .agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("n_records"), F.min(mark).alias("low"), F.max(mark).alias("high"))
        .select("sha256", F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads with one digest"))).alias("payload"), "n_records")
    )
    with lean(pages.sparkSession):
        store.write.option("compression", "zstd").parquet(f"{path}/payloads")
    long = facts.where(F.col("bytes") >= revisit_bytes)
    heads = long.groupBy("sha256").agg(F.max("page_id").alias("head"))
    joined = long.join(heads, "sha256").unionByName(facts.where(F.col("bytes") < revisit_bytes).withColumn("head", F.col("page_id")))
    again = ~F.col("page_id").eqNullSafe(F.col("head"))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    records = joined.select(
        "page_id",
        "sha256",
        _record_header(kind, F.col("page_id"), F.col("url"), F.col("sha1"), F.col("bytes"), F.col("head")).alias("warc_header"),
        _http_header(F.col("bytes")).alias("http_header"),
        "url",
    )
    with lean(pages.sparkSession):
        records.write.option("compression", "zstd").parquet(f"{path}/records")


def _field(name: str) -> Column:
    """Value of a field of the header block; every field but the last ends where the next line begins."""
    return F.nullif(F.regexp_extract("warc_header", f"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """What the archive says of each record, by its header; payload facts are taken anew from the stored bytes."""
    payloads = spark.read.schema("sha256 string, payload binary, n_records long").parquet(f"{path}/payloads")
    checked = payloads.select(
        "sha256",
        F.when(F.sha2("payload", 256) == F.col("sha256"), F.sha1("payload")).otherwise(F.raise_error(F.lit("a stored payload is damaged"))).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    records = spark.read.schema("page_id long, sha256 string, warc_header string, http_header string").parquet(f"{path}/records")
    parsed = records.select(
        F.regexp_extract(_field("WARC-Record-ID"), "<urn:page:(.*)>", 1).try_cast("long").alias("page_id"),
        "sha256",
        _field("WARC-Type").alias("record_type"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "sha1:(.*)", 1).alias("header_digest"),
        F.regexp_extract(_field("WARC-Refers-To"), "<urn:page:(.*)>", 1).try_cast("long").alias("refers_to"),
    )
    joined = parsed.join(checked, "sha256")
    same = F.when(F.col("header_digest") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("header and payload differ")))
    return joined.select("page_id", "payload_bytes", same.alias("payload_digest"), "record_type", "refers_to")


def archive_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record (the exact bytes of the WARC record), payload (those of the page, of a revisit too)."""
    payloads = spark.read.schema("sha256 string, payload binary, n_records long").parquet(f"{path}/payloads")
    records = spark.read.schema("page_id long, sha256 string, warc_header string, http_header string").parquet(f"{path}/records")
    body = F.when(_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    whole = F.concat(F.col("warc_header").cast("binary"), F.col("http_header").cast("binary"), body, F.lit(b"\r\n\r\n"))
    return records.join(payloads, "sha256").select("page_id", whole.alias("record"), "payload")


def op9_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Workspace(spark, 'warc').path}/archive"
    write_archive(table(spark, sf_dir, "pages"), path)
    return archive_index(spark, path)


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
h AS (SELECT b, max(page_id) AS head FROM p WHERE n >= 1000 GROUP BY b)
SELECT page_id, n AS payload_bytes, sha1(p.b) AS payload_digest,
       CASE WHEN head IS NULL OR page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to
FROM p LEFT JOIN h ON p.b = h.b
"""
