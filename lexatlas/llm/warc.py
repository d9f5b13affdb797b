"""WARC archives with content-addressed payloads.

An archive is two tables in a shared folder: ``content`` holds every payload
once under its digest, ``headers`` holds the exact header bytes of each record
and the digest it refers to. Joining the two gives back the original records
byte by byte; ``export`` writes them as WARC files. Digests are SHA-1 as the
format has it; a payload counts as the same only if its SHA-256 and length
agree as well.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.llm.common import shared_folder

#: Payloads below this many bytes are stored as responses even if they repeat.
REVISIT_BYTES = 1000
CRLF = "\r\n"
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:record:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _lines(*lines: Column) -> Column:
    """Header lines that apply, each ended by CRLF, and the empty line after them."""
    kept = F.array_compact(F.array(*lines))
    return F.concat(F.array_join(kept, CRLF), F.lit(CRLF + CRLF))


def write_archive(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", revisit_bytes: int = REVISIT_BYTES) -> str:
    """Write ``pages`` (page_id, url, html) as an archive below ``folder`` and return its path.

    A null html is an empty payload, a null url an empty target, a null id is
    smaller than any other; of rows that repeat the largest id each is a
    response; other columns are not read; an empty table gives empty tables.
    """
    path = f"{folder}/warc-{uuid.uuid4().hex}"
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload")).withColumn("sha256", F.sha2("payload", 256))
    key = ["sha1", "sha256", "bytes"]
    # Digests and ids only are exchanged here; a group's rows are combined before.
    groups = rows.groupBy(*key).agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("copies"))
    groups.write.parquet(f"{path}/groups")
    groups = rows.sparkSession.read.schema(groups.schema).parquet(f"{path}/groups")

    # The owner's row carries the payload; single payloads go straight to the table.
    owned = rows.join(groups, key).filter(F.col("page_id").eqNullSafe(F.col("owner")))
    content = owned.filter("copies = 1").select(*key, "payload").unionByName(owned.filter("copies > 1").select(*key, "payload").dropDuplicates(key))
    content.write.parquet(f"{path}/content")

    revisit = (F.col("bytes") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    kind = F.when(revisit, "revisit").otherwise("response")
    block = F.octet_length(F.lit(HTTP_HEAD)) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    header = _lines(
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("owner")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    )
    full = F.concat(header, F.lit(HTTP_HEAD)).cast("binary")
    headers = rows.drop("payload").join(groups.drop("copies"), key)
    headers.select("page_id", kind.alias("record_type"), full.alias("header"), *key).write.parquet(f"{path}/headers")
    return path


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive: ``record`` is the exact bytes of header and block; a revisit's payload is fetched by digest.

    ``verified`` is false where a stored payload does not give its digests.
    """
    content = spark.read.parquet(f"{path}/content")
    sound = (F.sha1("payload") == F.col("sha1")) & (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("bytes"))
    content = content.withColumn("verified", sound)
    joined = spark.read.parquet(f"{path}/headers").join(content, ["sha1", "sha256", "bytes"], "left")
    block = F.when(F.col("record_type") == "revisit", F.col("header")).otherwise(F.concat("header", "payload"))
    return joined.select("page_id", block.alias("record"), "payload", F.coalesce("verified", F.lit(False)).alias("verified"))


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?md)^{name}: (.*?)\r$", 1)
    return F.when(found != "", found)


def parse_records(records: DataFrame) -> DataFrame:
    """What the records say: page id, payload size and digest, type and the id referred to.

    Sizes and digests come from the payload bytes: those inside a response
    record, after its two heads, and those that a revisit points to.
    """
    def head_of(column: str) -> Column:
        return F.substring_index(F.col(column).cast("string"), CRLF + CRLF, 1)

    def after(column: str, head: Column) -> Column:
        return F.substr(F.col(column), (F.octet_length(head) + 5).cast("int"))

    raw = records.withColumn("_head", F.concat(head_of("record"), F.lit(CRLF)))
    length = _field(F.col("_head"), "Content-Length").cast("int")
    raw = raw.withColumn("_block", F.substr(F.col("record"), F.octet_length("_head") + 3, length))
    inside = after("_block", head_of("_block"))
    kind = _field(F.col("_head"), "WARC-Type")
    payload = F.when(kind == "revisit", F.col("payload")).otherwise(inside)
    number = lambda name: F.regexp_extract(_field(F.col("_head"), name), r"^<urn:record:page:(-?\d+)>$", 1).try_cast("long")
    told = F.regexp_extract(_field(F.col("_head"), "WARC-Payload-Digest"), r"^sha1:([0-9a-f]{40})$", 1)
    return raw.select(
        number("WARC-Record-ID").alias("page_id"),
        payload.alias("_payload"),
        kind.alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        told.alias("_told"),
        "verified",
    ).select(
        "page_id",
        F.octet_length("_payload").cast("long").alias("payload_bytes"),
        F.sha1("_payload").alias("payload_digest"),
        "record_type",
        "refers_to",
        (F.col("verified") & (F.sha1("_payload") == F.col("_told"))).alias("verified"),
    )


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write the pages as an archive in the shared folder, read it back and return what its records say."""
    spark = pages.sparkSession
    return parse_records(read_records(spark, write_archive(pages, shared_folder(spark))))


def export(spark: SparkSession, path: str, target: str, records_per_file: int = 20_000) -> None:
    """Write an archive's records as WARC files; each record ends with two CRLF, as the format asks."""
    records = read_records(spark, path).select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", records_per_file).text(target)
