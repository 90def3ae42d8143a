"""Ingest of the snapshots that arrived since the last time, each part file once.

A file stream over the snapshot folders remembers in its checkpoint which files it has seen, and takes what is new in batches of a
bounded number of files. Every batch is written to a folder of its own, named by the number that the stream gives it and
replaced if it exists: a batch that is repeated after a failure changes nothing. Nothing waits for data: the run ends when all files
that were there are done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vitrina.plans.clean import null_missing

FILES_PER_BATCH = 1000


def ingest_new_snapshots(
    spark: SparkSession, directory: str, prefix: str, schema: StructType, target: str, checkpoint: str, fmt: str = "csv",
    files_per_batch: int = FILES_PER_BATCH,
) -> int:
    """Append the rows of new snapshots `prefix*.<fmt>` of a directory to the Parquet table `target`; the number of batches done.

    Rows get `snapshot`, the name of the snapshot they came with, and missing-value texts are NULL. CSV files must have the columns of
    `schema` in that order, which their headers are checked for; Parquet is read by name. Snapshots appear under their names when
    they are finished, as Spark's writers leave them. `checkpoint` belongs to the one pair of directory and target.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if fmt == "csv":
        options = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "mode": "PERMISSIVE", "enforceSchema": False}
        reader = reader.options(**options)
    found = reader.format(fmt).load(f"{directory.rstrip('/')}/{prefix}*.{fmt}")
    name = F.regexp_extract("_metadata.file_path", rf"/({prefix}[^/]*)\.{fmt}(?:/[^/]*)?$", 1)
    rows = null_missing(found.select(*schema.names, name.alias("snapshot")))
    done = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")
        done.append(number)

    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)


def ingested(spark: SparkSession, schema: StructType, target: str) -> DataFrame:
    """All rows ingested so far, with their snapshot."""
    stored = StructType([*schema.fields, StructField("snapshot", StringType())])
    return spark.read.schema(stored).parquet(f"{target.rstrip('/')}/batch=*")
