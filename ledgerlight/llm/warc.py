"""WARC archives with revisit resolution.

Records are written by Spark's text writer: a record is one value, and the line separator is the
blank lines that end a WARC record. Every archive carries a fresh token in the second line of each
record, so that the reader can split files at whole records wherever a split begins: no payload
can hold the token, and each block is held against its Content-Length.

Payload headers (page, digest, length) are shuffled by digest; among equal payloads of at least
`least` bytes the largest page id stays a response and the others become revisit records that name
it. Page ids that repeat at the top are all responses. Page ids of any type are written URL-encoded
and read back as `id_type`, so text ids may hold any characters. Nulls: a null payload is empty, a null page
id is smaller than any other, a null url leaves out the header. An empty table gives an archive
without records.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import text_of

# Names and lines of the WARC 1.1 format.
CRLF = "\r\n"
VERSION = "WARC/1.1"
TOKEN = "X-Archive-Token"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST = 1000


def record_id(page_id: Column, digest: Column) -> Column:
    """urn:uuid of a record, the same in every run."""
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def page_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, uri, payload, payload_bytes, digest of every row; other columns are not read."""
    payload = text_of(html)
    return pages.select(
        F.col(f"`{page_id}`").alias("page_id"),
        F.regexp_replace(F.col(f"`{url}`").cast("string"), r"[\x00-\x20\x7F]", "%20").alias("uri"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )


def resolved(records: DataFrame, least: int = LEAST) -> DataFrame:
    """Add record_type, refers_to and refers_uri.

    The aggregate sees headers only and combines before its shuffle, so a payload that a third of
    the pages share is one row a task; the join back is left to the run-time choice of Spark, which
    splits skewed keys.
    """
    same = (
        records.filter(F.col("payload_bytes") >= least)
        .groupBy("digest", "payload_bytes")
        .agg(F.max("page_id").alias("_keep"), F.max_by("uri", "page_id").alias("_uri"), F.count("*").alias("_n"))
        .filter("_n > 1")
    )
    revisit = F.col("_n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keep"))
    return records.join(same, ["digest", "payload_bytes"], "left").select(
        *records.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_keep")).alias("refers_to"),
        F.when(revisit, F.col("_uri")).alias("refers_uri"),
    )


def _header(name: str, value: Column) -> Column:
    """A header line, nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def write_archive(records: DataFrame, path: str, date: str | None = None, compression: str = "gzip") -> str:
    """Write resolved records as WARC files with fresh headers; returns the archive's folder.

    A revisit record keeps the HTTP header and leaves out the payload.
    """
    token = uuid.uuid4().hex
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit(f"{VERSION}{CRLF}{TOKEN}: {token}{CRLF}"),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", F.concat(F.lit("<"), record_id(F.col("page_id"), F.col("digest")), F.lit(">"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("uri")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("X-Page-Id", F.url_encode(F.col("page_id").cast("string"))),
        _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _header("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<"), record_id(F.col("refers_to"), F.col("digest")), F.lit(">")))),
        _header("WARC-Refers-To-Target-URI", F.col("refers_uri")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))).cast("string"),
        F.lit(CRLF * 2),
    )
    at = f"{path.rstrip('/')}/{token}"
    records.select(F.concat(head, block).alias("value")).write.option("lineSep", CRLF * 2).option("compression", compression).text(at)
    return at


def read_archive(spark: SparkSession, archive: str, id_type: str = "long") -> DataFrame:
    """record_id, record_type, page_id, uri, digest, refers_id, payload (null in revisits).

    Fails on a block that is shorter than its Content-Length or a payload that misses its digest.
    """
    token = archive.rstrip("/").rsplit("/", 1)[1]
    opening = f"{VERSION}{CRLF}{TOKEN}: {token}{CRLF}"
    lines = spark.read.text(archive, lineSep=CRLF * 2 + opening)
    value = F.when(F.col("value").startswith(opening), F.substring("value", len(opening) + 1, 2**31 - 1)).otherwise(F.col("value"))
    cut = F.instr(F.col("record"), CRLF * 2)
    raw = lines.select(value.alias("record")).select(
        F.substring("record", F.lit(1), cut).alias("head"), F.substring(F.col("record"), cut + 4, F.lit(2**31 - 1)).alias("block")
    )

    def field(name: str) -> Column:
        got = F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1)
        return F.when(got != "", got)

    # an empty id is an id, a missing line is null
    page = F.when(F.col("head").rlike("(?m)^X-Page-Id: "), F.url_decode(F.regexp_extract("head", r"(?m)^X-Page-Id: ([^\r\n]*)", 1)))
    length = field("Content-Length").cast("int")
    whole = (
        F.when(F.octet_length("block") == length, F.col("block"))
        .when(F.octet_length("block") > length, F.substring(F.col("block").cast("binary"), F.lit(1), length).cast("string"))
        .otherwise(F.raise_error(F.lit("a record is shorter than its Content-Length")).cast("string"))
    )
    fields = raw.select(
        F.regexp_replace(field("WARC-Record-ID"), "[<>]", "").alias("record_id"),
        field("WARC-Type").alias("record_type"),
        page.cast(id_type).alias("page_id"),
        field("WARC-Target-URI").alias("uri"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        F.regexp_replace(field("WARC-Refers-To"), "[<>]", "").alias("refers_id"),
        whole.alias("block"),
    )
    body = F.substring(F.col("block"), F.instr(F.col("block"), CRLF * 2) + 4, F.lit(2**31 - 1))
    payload = F.when(F.col("record_type") == "response", body)
    read = fields.select("record_id", "record_type", "page_id", "uri", "digest", "refers_id", payload.alias("payload"))
    good = F.col("payload").isNull() | (F.sha1(F.col("payload").cast("binary")) == F.col("digest"))
    return read.withColumn("digest", F.when(good, F.col("digest")).otherwise(F.raise_error(F.lit("a payload misses its digest")).cast("string")))


def followed(records: DataFrame) -> DataFrame:
    """Read records with payload_bytes and refers_to of the full payload: revisits joined to responses.

    Only headers meet in the join; a response that many revisits name is a skewed key, which Spark
    splits.
    """
    heads = records.select("record_id", "record_type", "page_id", "uri", "digest", "refers_id", F.octet_length("payload").cast("long").alias("payload_bytes"))
    responses = heads.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_id")).agg(F.max("payload_bytes").alias("_bytes"), F.max("page_id").alias("refers_to"))
    return heads.join(responses, "refers_id", "left").select(
        "record_id", "record_type", "page_id", "uri", "digest", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "refers_to"
    )


def deduplicate_archive(spark: SparkSession, archive: str, path: str, least: int = LEAST, date: str | None = None, id_type: str = "long") -> str:
    """A second archive of the same pages, in which repeated payloads are revisit records."""
    read = read_archive(spark, archive, id_type)
    full = read.filter("record_type = 'response'").withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    kept = full.select("page_id", "uri", "payload", "payload_bytes", "digest")
    old = followed(read).filter("record_type = 'revisit'")
    payloads = full.groupBy("digest").agg(F.first("payload").alias("payload"))
    back = old.join(payloads, "digest").select("page_id", "uri", "payload", "payload_bytes", "digest")
    return write_archive(resolved(kept.unionByName(back), least), path, date)
