"""One large CSV file with quoted line breaks, read by as many tasks as it has byte ranges.

Where a record ends depends on all quotes before it, so a reader that starts in the middle of a file cannot know. Here Spark's text
source cuts the file into byte ranges and lines. Each range numbers its lines and counts, on its own, the lines with an odd number of
quotes: only these open or close a value that spans lines. One small row a range then gives prefix sums, and with them every line
knows how many such lines precede it in its file: an even number 2m says that it begins a record, 2m + 1 that it lies in the m-th
record of several lines. Lines that are records of their own go straight to `from_csv`; only lines of longer records are shuffled.

Files must quote as RFC 4180 says, and as `sinks` writes: quotes appear around whole values, and doubled inside them.

Defined cases: a file whose last quote is never closed is an error, so are files with different headers; empty lines between
records are skipped, line breaks are LF or CRLF; an empty file has no rows; a record with too few values is filled with NULL.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vitrina.sources.staging import stage_table

_OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
_LINES = "file string, start long, line long, odd boolean, odd_before long, text string"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their number in the byte range, and the number of lines with an odd count of quotes before them there."""
    at, line, odd_lines = None, 0, 0
    for batch in batches:
        files, starts = batch.column("file"), batch.column("start")
        ends = [0]  # of the runs of lines from one byte range
        for k in range(1, batch.num_rows):
            if starts[k] != starts[k - 1] or files[k] != files[k - 1]:
                ends.append(k)
        for first, stop in zip(ends, [*ends[1:], batch.num_rows]):
            part = batch.slice(first, stop - first)
            if not part.num_rows:
                continue
            here = (part.column("file")[0].as_py(), part.column("start")[0].as_py())
            if here != at:
                at, line, odd_lines = here, 0, 0
            odd = pc.bit_wise_and(pc.count_substring(part.column("text"), '"'), 1).cast(pa.int64())
            running = pc.cumulative_sum(odd)
            numbers = pa.array(range(line, line + part.num_rows), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("file"), part.column("start"), numbers, odd.cast(pa.bool_()), pc.add(pc.subtract(running, odd), odd_lines), part.column("text")],
                ["file", "start", "line", "odd", "odd_before", "text"],
            )
            line += part.num_rows
            odd_lines += running[-1].as_py()


def numbered_lines(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """file, start, line, odd, odd_before (in the whole file), text. Staged once: ranges depend on the executors at hand."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text"))
    lines = stage_table(lines.mapInArrow(_counted, _LINES), folder)
    ranges = lines.groupBy("file", "start").agg(F.count_if("odd").alias("odd_lines"))  # one small row a byte range
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage_table(ranges.withColumn("offset", F.coalesce(F.sum("odd_lines").over(before), F.lit(0))), folder)
    open_files = offsets.groupBy("file").agg(F.sum("odd_lines").alias("n")).where("n % 2 = 1").limit(1).collect()
    if open_files:
        raise ValueError(f"{open_files[0].file}: a quote is never closed")
    placed = lines.join(offsets.select("file", "start", "offset"), ["file", "start"])
    return placed.withColumn("odd_before", F.col("odd_before") + F.col("offset")).drop("offset")


def records(lines: DataFrame) -> DataFrame:
    """file, start, line (of the first line) and text of every record."""
    inside = F.col("odd_before") % 2 == 1
    whole = lines.where(~inside & ~F.col("odd")).select("file", "start", "line", "text")
    parts = lines.where(inside | F.col("odd")).withColumn("number", F.floor(F.col("odd_before") / 2))
    # A group is the lines of one record, that is of one row of the result.
    joined = parts.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("start", "line", "text"))).alias("lines"))
    first = F.col("lines")[0]
    text = F.array_join(F.transform("lines", lambda part: part["text"]), "\n")
    return whole.unionByName(joined.select("file", first["start"].alias("start"), first["line"].alias("line"), text.alias("text")))


def scan_large_csv(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """The rows of headed CSV files as texts, the columns of the header; every task reads a byte range."""
    found = records(numbered_lines(spark, path, folder))
    found = found.withColumn("text", F.regexp_replace("text", "\r$", ""))
    heading = (F.col("start") == 0) & (F.col("line") == 0)
    headers = [row.text for row in found.where(heading).select("text").distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValueError(f"{path}: files with different headers")
    names = spark.read.options(**_OPTIONS).option("header", True).csv(path).columns
    schema = StructType([StructField(name, StringType()) for name in names])
    # The schema of from_csv as DDL, so that any column name is taken as it is written.
    ddl = ", ".join(f"`{name.replace('`', '``')}` string" for name in schema.names)
    rows = found.where(~heading & (F.col("text") != "")).select(F.from_csv("text", F.lit(ddl), _OPTIONS).alias("row"))
    return rows.select(*[F.col("row").getField(name).alias(name) for name in names])
