"""WARC archives with revisit records: pages to records, digests shuffled, archives written and read back.

A record is a row (page_id, url, payload). Only headers (id, digest, length) are grouped: one largest id per digest that
occurs more than once, combined before the shuffle. Records then join these groups on digest and length; adaptive execution
splits the rows of a hot digest. Archives are written by Spark's text writer, whose line separator is the end of a WARC
record; one archive at a time is read back, record by record out of its compressed bytes.

Defined cases: a NULL payload is an empty one. A NULL id counts as smaller than any other, and a record whose group has only
NULL ids refers to none and is a response. Rows that repeat the largest id of a group are all responses. Line breaks in urls
become spaces in headers. Other columns have no effect. No rows make no archives and no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vitrina.llm.common import flat_map_rows
from vitrina.sources.staging import shared_folder

END = "\r\n\r\n"
RECORDS_PER_FILE = 2000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_ID = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight times five hex digits to four characters."""
    hexed = F.sha1(payload)

    def four(at: Column) -> Column:
        number = F.conv(F.substr(hexed, at, F.lit(5)), 16, 10).cast("int")
        letters = [F.substr(F.lit(BASE32), F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
        return F.concat(*letters)

    return F.concat(*[four(F.lit(1 + 5 * k)) for k in range(8)])


def resolve_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add payload_bytes, payload_digest, record_type and refers_to to rows with page_id and payload (a string)."""
    payload = F.coalesce(F.col("payload"), F.lit("")).cast("binary")
    headed = records.withColumns({"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": base32_sha1(payload)})
    groups = (
        headed.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("copies"))
        .where("copies > 1 AND original IS NOT NULL")
        .select(F.col("payload_digest").alias("group_digest"), F.col("payload_bytes").alias("group_bytes"), "original")
    )
    # The hash of the digest keeps the join from reusing the grouping's shuffle: of two fresh ones, hot parts can be split.
    same = (
        (F.col("payload_digest") == F.col("group_digest"))
        & (F.col("payload_bytes") == F.col("group_bytes"))
        & (F.xxhash64("payload_digest") == F.xxhash64("group_digest"))
    )
    refers = F.when(F.coalesce(F.col("page_id") != F.col("original"), F.col("original").isNotNull()), F.col("original"))
    joined = headed.join(groups, same, "left").withColumn("refers_to", refers)
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return joined.withColumn("record_type", kind).drop("group_digest", "group_bytes", "original")


def _uri(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archives(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Gzipped WARC files with fresh headers; revisits keep the HTTP header and leave the payload out."""
    revisit = F.col("record_type") == "revisit"
    lines = "\r\n"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{lines}Content-Type: text/html; charset=utf-8{lines}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(END),
    )
    body = F.when(revisit, http).otherwise(F.concat(http, F.coalesce("payload", F.lit(""))))
    clean_url = F.regexp_replace("url", r"[\r\n]+", " ")
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "), _uri(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), clean_url), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), _uri(F.col("refers_to")), F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("body").cast("string"), F.lit(END), F.col("body"),
    )
    rows = resolved.withColumn("body", body).select(record.alias("value"))
    rows.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_archive(content: bytes):
    """Records of one archive: header fields and block."""
    return parse_records(io.BytesIO(content))


def parse_records(archive: BinaryIO):
    """Records of an open archive, one in memory at a time."""
    while archive.readline():  # the version, or the end
        lines = iter(lambda: archive.readline().decode("utf-8").removesuffix("\r\n"), "")
        fields = dict(line.split(": ", 1) for line in lines)
        block = archive.read(int(fields["Content-Length"]))
        if archive.read(len(END)) != END.encode():
            raise ValueError(f"record {fields.get('WARC-Record-ID')} does not end where its length says")
        yield fields, block


def _record(fields: dict, block: bytes, payloads: bool) -> tuple:
    head, _, payload = block.partition(END.encode())
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    stated = int(dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])["Content-Length"])
    if kind == "response" and (len(payload) != stated or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its headers")

    def page(name):
        text = fields.get(name, "none").strip("<>").removeprefix(RECORD_ID)
        return None if text == "none" else int(text)

    kept = payload if payloads and kind == "response" else None
    return page("WARC-Record-ID"), stated, digest, kind, page("WARC-Refers-To"), fields.get("WARC-Target-URI"), kept


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of all archives below a path. Lengths and digests of responses are checked against their payloads."""

    def parse(part):
        columns = [[] for _ in range(7)]
        for content in part.column("content").to_pylist():
            for fields, block in parse_records(gzip.GzipFile(fileobj=io.BytesIO(content))):
                for column, value in zip(columns, _record(fields, block, payloads)):
                    column.append(value)
        return dict(zip([c.strip().split()[0] for c in READ.split(",")], columns))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path)
    return flat_map_rows(files.select("content"), parse, READ, at_once=1)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages (page_id, url, html) written as deduplicated archives below the shared folder, and read back."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/archives"
    records = pages.select("page_id", "url", F.col("html").alias("payload"))
    write_archives(resolve_revisits(records, min_bytes), path)
    return read_archives(spark, path)
