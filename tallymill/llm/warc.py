"""Content-addressed WARC archive.

An archive is two Parquet tables in one folder. `payloads` holds each distinct payload once, under its SHA-256. `records`
holds, per record, the exact header block and the digest of its payload. The bytes of a WARC file come back by joining the
two. Of the records with equal payloads the one with the smallest id is a response; the others are revisits, which name it
and, as the format has it, carry no block.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm.common import kept, release, shared_folder, text_or_empty

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def base32(hexadecimal: Column) -> Column:
    """Bare upper-case base32 of a hexadecimal SHA-1: 40 bits, two groups of five hexadecimal digits, at a time."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    groups = []
    for k in range(4):
        bits = F.conv(F.substring(hexadecimal, 10 * k + 1, 10), 16, 10).cast("long")
        groups += [F.substring(letters, F.shiftright(bits, 35 - 5 * j).bitwiseAND(31).cast("int") + 1, F.lit(1)) for j in range(8)]
    return F.concat(*groups)


def record_id(record: Column, number: Column) -> Column:
    """A record's own URI: its number within the archive tells records of one id apart."""
    name = F.when(record.isNull(), F.lit("record")).otherwise(F.concat(F.lit("page:"), F.url_encode(record.cast("string"))))
    return F.concat(F.lit("<urn:tallymill:"), name, F.lit(":"), number.cast("string"), F.lit(">"))


def header(kind: str, date: str) -> Column:
    """The header block of a record, up to and with the empty line."""
    common = [
        F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.lit(kind)),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("_id"), F.col("_number"))), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(F.col("_url"), F.lit("")), r"[\r\n]+", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
    ]
    if kind == "response":
        own = [F.lit("Content-Type: text/html; charset=UTF-8"), F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string"))]
    else:
        own = [
            F.concat(F.lit("WARC-Profile: "), F.lit(REVISIT_PROFILE)),
            F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("_first.id"), F.col("_first.number"))), F.lit("Content-Length: 0"),
        ]
    return F.concat(F.concat_ws(END, *common, *own), F.lit(END + END))


def write_archive(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
                  least_bytes: int = 0, date: dt.datetime | None = None) -> None:
    """Write one record per row of pages below `path`; `date` is when they were fetched (default: now).

    Null payloads are empty ones, null urls are written empty. Payloads of fewer than `least_bytes` bytes are responses
    every time (stored once all the same). Repeated rows are a record each, of the same type, with a record id of its own;
    a revisit names the first of several. A null id comes after all others. Further columns are ignored; no rows make an
    empty archive.
    """
    spark = pages.sparkSession
    when = (date or dt.datetime.now(dt.timezone.utc)).astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.encode(text_or_empty(payload_column), "UTF-8")
    rows = pages.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{url_column}`").cast("string").alias("_url"), payload.alias("payload"))
    # Written, so that a record's number is the same wherever it is named.
    scratch: list[str] = []
    facts = kept(rows.select(
        "_id", "_url", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("_sha1"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.monotonically_increasing_id().alias("_number"),
    ), "facts", scratch)
    # A hot payload leaves one row per task here: the smallest id of a digest is taken before anything is shuffled.
    least = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_number").alias("number"))
    first = facts.groupBy("sha256").agg(F.min(least).alias("_first"))
    joined = facts.join(first, "sha256").withColumn("payload_digest", base32(F.col("_sha1")))
    response = (F.col("payload_bytes") < least_bytes) | F.col("_id").eqNullSafe(F.col("_first.id"))
    joined.select(
        F.col("_id").alias("record"), F.when(response, header("response", when)).otherwise(header("revisit", when)).alias("header"), "sha256",
    ).write.parquet(f"{path}/records")
    release(spark, scratch)
    # One row per digest and task is shuffled, so a payload that a third of all pages share is no hot key.
    rows.select(F.sha2("payload", 256).alias("sha256"), "payload").dropDuplicates(["sha256"]).write.parquet(f"{path}/payloads")


def verified_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads; a payload that its digest doesn't fit fails the read."""
    stored = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    return stored.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not fit its digest "), F.col("sha256"))).cast("binary")))


def headers(spark: SparkSession, path: str, record_type: str = "bigint") -> DataFrame:
    """The stored header blocks and what they say: record_id, date, record, kind, digest, refers_to."""
    stored = spark.read.parquet(f"{path}/records")

    def field(name: str) -> Column:
        return F.regexp_extract("header", rf"\n{name}: ([^\r\n]*)", 1)

    def of_id(value: Column) -> Column:
        name = F.regexp_extract(value, r"^<urn:tallymill:page:(.*):\d+>$", 1)
        return F.when(value.startswith("<urn:tallymill:page:"), F.url_decode(name)).cast(record_type)

    return stored.select(
        field("WARC-Record-ID").alias("record_id"), field("WARC-Date").alias("date"), of_id(field("WARC-Record-ID")).alias("record"), field("WARC-Type").alias("kind"), field("WARC-Target-URI").alias("url"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"), of_id(field("WARC-Refers-To")).alias("refers_to"),
        "header", "sha256",
    )


def read_index(spark: SparkSession, path: str, record_type: str = "bigint") -> DataFrame:
    """Per record, from the archive alone: record, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest are those of the stored payload, which a revisit finds through the digest; a header that says another
    digest fails the read. Only facts about payloads are joined, never their bytes.
    """
    facts = verified_payloads(spark, path).select(
        "sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"),
    )
    same = F.col("digest") == F.col("payload_digest")
    return headers(spark, path, record_type).join(facts, "sha256", "left").select(
        "record", "payload_bytes",
        F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("digest differs in "), F.col("header")))).alias("payload_digest"),
        F.col("kind").alias("record_type"), "refers_to",
    )


def reconstruct(spark: SparkSession, path: str, record_type: str = "bigint") -> DataFrame:
    """Per record: its original bytes as a WARC file has them, and the full payload (of revisits too)."""
    block = F.when(F.col("kind") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return headers(spark, path, record_type).join(verified_payloads(spark, path), "sha256").select(
        "record", F.concat(F.encode("header", "UTF-8"), block, F.encode(F.lit(END + END), "UTF-8")).alias("warc"), "payload",
    )


def archive_pages(pages: DataFrame, path: str | None = None, id_column: str = "page_id", url_column: str = "url",
                  payload_column: str = "html", least_bytes: int = 0, date: dt.datetime | None = None) -> DataFrame:
    """Write the archive (in the shared folder if no path is given), then read its index back."""
    spark = pages.sparkSession
    path = path or shared_folder(spark, "warc")
    write_archive(pages, path, id_column, url_column, payload_column, least_bytes, date)
    return read_index(spark, path, pages.schema[id_column].dataType.simpleString()).withColumnRenamed("record", id_column)
