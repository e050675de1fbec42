"""Content-addressed WARC archive.

The archive is two tables. ``payloads`` holds every different payload once, by its SHA-256.
``records`` holds, per page, the exact bytes of its record's headers: the WARC header and, below
it, the HTTP header of the response. A record is its headers, its payload if it is a
response, and two line ends; reading joins the tables by digest and gives back whole records. Payloads are hashed again when
they are read, and one that does not match its digest is an error. What ``round_trip`` reports of a payload is measured on the
bytes cut out of its rebuilt record by the lengths in its headers.

Of pages with equal payloads of at least ``revisit_from`` bytes, the one with the smallest
page_id is a ``response``; the others are ``revisit`` records, which name it and have no payload.
Shorter payloads always get a ``response``.

Equal payloads are brought together by an aggregate that keeps one per task before it moves
them, so a payload that a third of all pages share costs one row per task. Its records are
narrow and joined; Spark splits such a join where it is skewed. Payloads are stored in buckets by digest, so that records
come to them: long payloads are not shuffled again. Short ones, of which any number of records may hold the same, are joined apart. A very long
payload is one row. Payloads with equal digests are taken for equal, as SHA-256 has no known collisions.

A null page has an empty payload. Pages without an id come after all others; a group of equal
long payloads without any id has only responses. Rows that repeat a page_id and payload
are the same page again: each is the response if that id is the smallest. A null url gives a
record without target. Extra columns are ignored. An empty table gives an empty archive.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward.session import fresh_path, written

REVISIT_FROM = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


@dataclass
class Archive:
    """Folders of an archive, and the session's name for its payloads, if this session wrote them."""

    payloads: str
    records: str
    table: str | None = None


def lines(*parts: Column) -> Column:
    """Header lines, null ones left out, and the empty line after them."""
    return F.concat(F.concat_ws(END, *parts), F.lit(2 * END))


def field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"[\r\n]+", " ")


def write_archive(pages: DataFrame, folder: str, revisit_from: int = REVISIT_FROM, date: str = DATE) -> Archive:
    """Write the archive of ``pages`` (page_id, url, html) below ``folder``."""
    spark = pages.sparkSession
    archive = Archive(f"{folder}/payloads", f"{folder}/records", f"warc_payloads_{uuid.uuid4().hex}")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    hashed = pages.select("page_id", body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    stored = hashed.groupBy("digest").agg(F.min("page_id").alias("first_page"), F.first("payload").alias("payload"))
    stored.write.bucketBy(buckets, "digest").sortBy("digest").format("parquet").option("path", archive.payloads).saveAsTable(archive.table)
    named = spark.table(archive.table).select("digest", "first_page")
    narrow = pages.select("page_id", "url", body.alias("payload")).select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    revisit = F.coalesce((F.col("payload_bytes") >= revisit_from) & ~F.col("page_id").eqNullSafe(F.col("first_page")) & F.col("first_page").isNotNull(), F.lit(False))
    http = lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), field("Content-Length", F.col("payload_bytes").cast("string")))
    block_bytes = F.octet_length("http") + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("payload_bytes"))
    header = lines(
        F.lit("WARC/1.1"),
        F.when(F.col("revisit"), F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        field("WARC-Record-ID", record_id(F.col("page_id"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", one_line(F.col("url"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("revisit"), field("WARC-Profile", F.lit(PROFILE))),
        F.when(F.col("revisit"), field("WARC-Refers-To", record_id(F.col("first_page")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        field("Content-Length", block_bytes.cast("string")),
    )
    records = narrow.join(named, "digest").withColumn("revisit", revisit).withColumn("http", http)
    records.select("page_id", "digest", F.concat(header, F.col("http")).cast("binary").alias("headers")).write.parquet(archive.records)
    return archive


def read_payloads(spark: SparkSession, archive: Archive, in_buckets: bool = True) -> DataFrame:
    """digest, payload; raises where a payload does not match its digest.

    Without buckets a join may split the rows of a digest over tasks.
    """
    stored = spark.table(archive.table) if archive.table and in_buckets else spark.read.schema("digest string, payload binary").parquet(archive.payloads)
    same = F.sha2("payload", 256) == F.col("digest")
    verified = F.when(same, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary"))
    return stored.select("digest", verified.alias("payload"))


def read_headers(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id, digest, headers and the fields that are parsed from the headers; ``length`` is that of the payload."""

    def value(name: str) -> Column:
        found = F.regexp_extract("text", rf"\r\n{name}: ([^\r\n]*)", 1)
        return F.when(found != "", found)

    read = spark.read.parquet(archive.records).withColumn("text", F.col("headers").cast("string"))
    return read.select(
        "page_id",
        F.regexp_replace(value("WARC-Payload-Digest"), "^sha256:", "").alias("digest"),
        "headers",
        F.regexp_extract("text", r"(?s)\r\n\r\n.*\r\nContent-Length: ([0-9]+)\r\n\r\n$", 1).cast("long").alias("length"),
        value("WARC-Type").alias("record_type"),
        F.regexp_extract(value("WARC-Refers-To"), "<urn:page:(-?[0-9]+)>", 1).cast("long").alias("refers_to"),
    )


def read_archive(spark: SparkSession, archive: Archive, short: int = REVISIT_FROM) -> DataFrame:
    """page_id, digest, record_type, refers_to and the whole record's bytes of every page.

    Records with payloads shorter than ``short``, which may share one, and longer ones are joined apart.
    """
    headers = read_headers(spark, archive)
    payloads, spread = (read_payloads(spark, archive, in_buckets) for in_buckets in (True, False))
    kept = ("page_id", "digest", "record_type", "refers_to")
    response, length = F.col("record_type") == "response", F.octet_length("payload")
    ends = F.lit(END * 2).cast("binary")
    whole = lambda records, bodies: records.join(bodies, "digest").select(*kept, F.concat("headers", "payload", ends).alias("record"))
    long = whole(headers.where(response & (F.col("length") >= short)), payloads.where(length >= short))
    brief = whole(headers.where(response & (F.col("length") < short)), spread.where(length < short))
    revisits = headers.where(~response).select(*kept, F.concat("headers", ends).alias("record"))
    return long.unionByName(brief).unionByName(revisits)


def payload_of(record: Column) -> Column:
    """The payload of a response, cut out of its record by the lengths in its headers."""

    def cut(part: Column) -> Column:
        """The bytes below the first empty line, as many as the header above it says."""
        head = F.substring_index(part.cast("string"), END * 2, 1)
        length = F.regexp_extract(head, r"(?:^|\r\n)Content-Length: ([0-9]+)(?:\r\n|$)", 1).cast("int")
        return F.substring(part, F.octet_length(head) + 5, length)

    return cut(cut(record))


def round_trip(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from a fresh archive.

    Sizes and digests of responses are those of the payloads cut out of their records; revisits take those of the
    response they name by its digest.
    """
    spark = pages.sparkSession
    archive = write_archive(pages, fresh_path(spark, "warc"), revisit_from)
    records = read_archive(spark, archive, revisit_from).withColumn("body", F.when(F.col("record_type") == "response", payload_of(F.col("record"))))
    shown = ["page_id", F.octet_length("body").cast("long").alias("payload_bytes"), F.sha2("body", 256).alias("payload_digest"), "record_type", "refers_to"]
    read = written(records.select(*shown, F.col("digest").alias("named")), "read")
    responses = read.where("record_type = 'response'").drop("named")
    measured = responses.groupBy("payload_digest").agg(F.first("payload_bytes").alias("payload_bytes"))
    revisits = read.where("record_type = 'revisit'").select("page_id", F.col("named").alias("payload_digest"), "record_type", "refers_to")
    return responses.unionByName(revisits.join(measured, "payload_digest").select(*responses.columns))
