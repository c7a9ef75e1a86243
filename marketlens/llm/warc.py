"""Content-addressed web archive: payloads once by digest, record headers apart, records rebuilt by a join.

``write_archive`` stores two tables: ``payloads`` (address, payload), one row per distinct SHA-256 of the payload bytes,
and ``headers``, the exact WARC header block of every record with its payload's address.  The first page of equal
payloads is a ``response``; the others are ``revisit`` records that refer to it.  ``read_records`` parses the stored
header blocks, verifies each payload against its address and joins the two; ``rebuild`` gives the record bytes.

Nulls: a null html is an empty payload; a null url leaves out the target header; a null page_id never becomes the record
that others refer to unless all of a payload's pages have none.  Repeated rows with the smallest id are all responses.
A header block holds a url of any length whole, with line feeds and carriage returns as percent codes; payloads are whole.  Extra columns are ignored; empty tables give no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import scratch

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # base32 of RFC 4648 (fixed value)
DATE = "2024-01-01T00:00:00Z"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a 160-bit digest in hex: each five hex digits are four letters."""
    number = lambda part: F.conv(F.substring(digest, 5 * part + 1, F.lit(5)), 16, 10).cast("int")
    letter = lambda n, shift: F.substring(F.lit(ALPHABET), F.shiftright(n, shift).bitwiseAND(31) + 1, F.lit(1))
    numbers = F.transform(F.sequence(F.lit(0), F.lit(7)), number)
    return F.array_join(F.transform(numbers, lambda n: F.concat(*[letter(n, s) for s in (15, 10, 5, 0)])), "")


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = DATE) -> None:
    """Write ``path/payloads`` and ``path/headers``; payloads under ``min_revisit_bytes`` are never revisits."""
    spark = pages.sparkSession
    keyed = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keyed = keyed.withColumn("address", F.sha2("payload", 256))
    # equal payloads meet before the shuffle, so a hot payload sends one row from each task
    stored = keyed.groupBy("address").agg(F.first("payload").alias("payload"), F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    known = spark.read.parquet(f"{path}/payloads").select("address", "first_id", "copies")
    rows = keyed.select("page_id", "url", "address", F.octet_length("payload").alias("n"), base32_of_hex(F.sha1("payload")).alias("sha1"))
    rows = rows.join(known, "address")
    revisit = (F.col("copies") > 1) & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("n") >= min_revisit_bytes)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda column: F.concat(F.lit("<urn:page:"), F.coalesce(column.cast("string"), F.lit("none")), F.lit(">"))
    when = lambda condition, value: F.when(condition, value).otherwise(F.lit(""))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        when(F.col("url").isNotNull(), line("WARC-Target-URI", _one_line(F.coalesce("url", F.lit(""))))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("first_id"))))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, 0).otherwise(F.col("n")).cast("string")),
        F.lit("\r\n"),
    )
    rows.select("address", header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def _one_line(value: Column) -> Column:
    """Line ends of a header's value as percent codes."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _field(name: str) -> Column:
    """The first header of that name; only a line feed ends a line, as ``(?d)`` says."""
    found = F.regexp_extract("header", rf"(?md)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The archive's records: header fields, and of the payload its size, SHA-1 and whether it matches its address."""
    payloads = spark.read.parquet(f"{path}/payloads").select(
        "address",
        *(["payload"] if with_payload else []),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_of_hex(F.sha1("payload")).alias("payload_digest"),
        (F.sha2("payload", 256) == F.col("address")).alias("verified"),
    )
    page = lambda name: F.regexp_extract(_field(name), r"<urn:page:(-?\d+)>", 1)
    number = lambda name: F.when(page(name) != "", page(name).cast("long"))
    headers = spark.read.parquet(f"{path}/headers").select(
        "header",
        "address",
        number("WARC-Record-ID").alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "sha1:(.*)", 1).alias("header_digest"),
    )
    return headers.join(payloads, "address")


def rebuild(spark: SparkSession, path: str) -> DataFrame:
    """page_id, ``record``: the record's bytes as written (a revisit has no body), and ``payload``, its whole payload."""
    records = read_records(spark, path, with_payload=True)
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.select("page_id", F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n")).alias("record"), "payload")


def archive_and_read(pages: DataFrame) -> DataFrame:
    spark, path = pages.sparkSession, scratch(pages.sparkSession, "warc")
    write_archive(pages, path)
    records = read_records(spark, path)
    intact = F.col("verified") & (F.col("header_digest") == F.col("payload_digest"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", intact.alias("intact"))
