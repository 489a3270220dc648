"""A content-addressed WARC archive: payload bytes once, exact headers apart, records by join.

An archive is two tables. ``payloads`` holds each payload once under its SHA-256 digest, in buckets
of that digest, so records meet payloads without moving payloads again. ``records`` holds every
record's exact header bytes and the digest. Reading joins both and checks the digest of what was
read; a payload that doesn't match its address stops the job.
"""

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, work_folder

END = "\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@dataclass
class Archive:
    """Names of the payload table and of the folder of record headers."""

    payloads: str
    records: str


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 digest, 32 characters; the digest is computed once."""

    def letters(hexadecimal):
        out = []
        for five in range(8):
            bits = F.conv(F.substring(hexadecimal, 5 * five + 1, 5), 16, 10).cast("int")
            for shift in (15, 10, 5, 0):
                out.append(F.substring(F.lit(_BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
        return F.concat(*out)

    return F.transform(F.array(F.sha1(payload)), letters)[0]


def page_payloads(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload) of pages: html in UTF-8, null is empty; line ends in a url escaped."""
    url = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "\r", "%0D"), "\n", "%0A")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))


def _header(kind: Column, refers: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    urn = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(kind == "revisit", line("WARC-Refers-To", urn(refers))).otherwise(""),
        line("Content-Length", F.col("n").cast("string")),
        F.lit(END),
    )


def write_archive(pages: DataFrame, min_bytes: int = 0) -> Archive:
    """Archive one record for every row of ``pages`` (page_id, url, html).

    Of records with equal payloads of ``min_bytes`` bytes or more, that of the largest page_id is a
    response and the others revisit it; those of smaller payloads are all responses. A null page_id
    counts as smaller than any and is written as an empty id; rows that repeat the largest page_id
    of a payload are all responses. Other columns are left aside; no rows give an empty archive.
    """
    spark = pages.sparkSession
    rows = page_payloads(pages)
    address = F.sha2("payload", 256).alias("address")
    narrow = rows.select("page_id", "url", address, base32_sha1(F.col("payload")).alias("digest"), F.length("payload").alias("n"))
    narrow = stored(narrow, "pages")
    first = narrow.groupBy("address").agg(F.max("page_id").alias("first"))
    met = narrow.join(first, "address")
    revisit = (F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    kind = F.when(revisit, "revisit").otherwise("response")
    records = f"{work_folder(spark)}/llm-records-{uuid.uuid4().hex}"
    met.select("address", _header(kind, F.col("first")).cast("binary").alias("header")).write.parquet(records)
    payloads = f"llm_payloads_{uuid.uuid4().hex}"
    once = rows.select(address, "payload").groupBy("address").agg(F.first("payload").alias("payload"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once.write.format("parquet").option("compression", "zstd").bucketBy(buckets, "address").saveAsTable(payloads)
    return Archive(payloads, records)


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """(header, payload) of every record, as bytes; a record is both and two line ends.

    A payload whose bytes don't have the digest that it is stored under fails the job.
    """
    payloads = spark.read.table(archive.payloads).withColumnRenamed("address", "of")
    records = spark.read.schema("address string, header binary").parquet(archive.records)
    met = records.join(payloads, F.col("address") == F.col("of"))
    wrong = F.raise_error(F.concat(F.lit("payload damaged: "), F.col("address")))
    return met.select("header", F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(wrong.cast("binary")).alias("payload"))


def record_bytes(records: DataFrame) -> DataFrame:
    """(record) the exact bytes of each WARC record."""
    return records.select(F.concat("header", "payload", F.lit(END + END).cast("binary")).alias("record"))


def parsed_records(records: DataFrame) -> DataFrame:
    """Fields of the headers, length and digest of the payloads that came with them."""
    head = F.col("header").cast("string")
    field = lambda name: F.regexp_extract(head, rf"(?:^|\n){name}: ([^\r]*)\r\n", 1)
    page = lambda name: F.nullif(F.regexp_extract(field(name), "^<urn:page:(.*)>$", 1), F.lit("")).cast("long")
    return records.select(
        page("WARC-Record-ID").alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        field("WARC-Target-URI").alias("target_uri"),
    )
