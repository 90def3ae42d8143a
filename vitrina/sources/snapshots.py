"""CSV snapshots: typed scans and the choice of the newest one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vitrina.plans.clean import null_missing
from vitrina.schemas import LISTING_SCHEMA, POSTING_SCHEMA
from vitrina.sources import hadoop
from vitrina.sources.large_csv import scan_large_csv


def _require(path: str, schema: StructType, names) -> None:
    missing = [name for name in schema.names if name not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")


def scan_snapshot(spark: SparkSession, path: str, schema: StructType, multi_line: bool = True) -> DataFrame:
    """A headed CSV file, or a directory of part files, with missing-value texts as NULL.

    Columns are taken by the names in the header, in any order; further columns are left out, a missing one is an error, and
    so is a part file whose header differs from the others.

    A path that ends in `.parquet` is read as such: only the columns that are used, and no text is parsed.

    Quoted line breaks need `multi_line`, which reads every file in one task; snapshots written by `sinks` are cut into
    files of bounded length. Set it to False for single huge files known to hold one record per line: they then split. Single
    huge files with line breaks in values are for `scan_large_snapshot`.
    """
    if path.rstrip("/").endswith(".parquet"):
        stored = spark.read.parquet(path)
        _require(path, schema, stored.columns)
        return null_missing(stored.select(*[F.col(name).cast("string").alias(name) for name in schema.names]))
    reader = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
    )
    names = reader.csv(path).columns
    _require(path, schema, names)
    written = StructType([StructField(name, StringType()) for name in names])
    rows = reader.option("enforceSchema", False).schema(written).csv(path)
    return null_missing(rows.select(*schema.names))


def scan_listings(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return scan_snapshot(spark, path, LISTING_SCHEMA, multi_line)


def scan_postings(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return scan_snapshot(spark, path, POSTING_SCHEMA, multi_line)


def scan_large_snapshot(spark: SparkSession, path: str, schema: StructType, folder: str | None = None) -> DataFrame:
    """Like `scan_snapshot`, for single large CSV files with quoted line breaks: every task reads a byte range."""
    rows = scan_large_csv(spark, path, folder)
    _require(path, schema, rows.columns)
    return null_missing(rows.select(*schema.names))


def latest_snapshot(spark: SparkSession, directory: str, prefix: str) -> str:
    """Path of the newest finished `prefix*.csv` or `prefix*.parquet` in the directory: a file, or a directory with `_SUCCESS`.

    Only the names in the directory itself are listed, however many part files its snapshots have. Equal times are settled
    by the path.
    """
    root = directory.rstrip("/")
    listed = hadoop.list_folder(spark, root) if hadoop.exists(spark, root) else []
    found = [(time, path, folder) for name, path, folder, time in listed if name.startswith(prefix) and name.endswith((".csv", ".parquet"))]
    for _, path, folder in sorted(found, reverse=True):
        if not folder or hadoop.exists(spark, f"{path}/_SUCCESS"):
            return path
    raise FileNotFoundError(f"no snapshot {prefix}* in {directory}")
