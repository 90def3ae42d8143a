"""An index of the keys of earlier snapshots, so that a new snapshot can be cleaned of them without reading them again.

The index is a folder with the keys in hash buckets and a Bloom filter of fixed size. A new key that the filter does not know is new
for certain and costs one broadcast lookup; only the others meet the index in an exact join. The buckets have the partitioning
that the join asks for, so what is old is read, never shuffled; what is shuffled are new rows that the filter lets through.

With the filter's 33 million bits about one new key in a hundred is looked up needlessly at 3 million old keys, and all of them at
hundreds of millions; results stay exact, and a larger `chunks` keeps the lookups few.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vitrina.operators import bloom
from vitrina.sources import hadoop
from vitrina.sources.staging import stage_table

BUCKETS = 64


def key_text(key: Column) -> Column:
    """A key as text that is never NULL."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def _table(spark: SparkSession, path: str) -> str:
    """The index's keys as a bucketed table of this session's catalog; its files lie below `path`."""
    name = "vitrina_keys_" + hashlib.sha256(path.encode()).hexdigest()[:24]
    if not spark.catalog.tableExists(name) and hadoop.exists(spark, f"{path}/keys"):
        buckets = spark.read.parquet(f"{path}/buckets").first().buckets
        spark.sql(f"CREATE TABLE {name} (key STRING) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{path}/keys'")
    return name


def add_keys(keys: DataFrame, path: str, buckets: int = BUCKETS, chunks: int = bloom.CHUNKS) -> None:
    """Add the one text column `key` to the index in folder `path`; the first call makes the index and fixes its sizes."""
    spark, name = keys.sparkSession, _table(keys.sparkSession, path)
    if hadoop.exists(spark, f"{path}/buckets"):
        sizes = spark.read.parquet(f"{path}/buckets").first()
        buckets, chunks = sizes.buckets, sizes.chunks
    else:
        spark.createDataFrame([(buckets, chunks)], "buckets int, chunks int").coalesce(1).write.parquet(f"{path}/buckets")
    keys = stage_table(keys.select("key").distinct())
    bloom.bitmaps(keys, "key", chunks).coalesce(1).write.mode("append").parquet(f"{path}/filter")  # at most `chunks` rows of 4 kB
    (
        keys.repartition(buckets, "key").write.mode("append").format("parquet").bucketBy(buckets, "key").sortBy("key")
        .option("path", f"{path}/keys").saveAsTable(name)
    )


def unseen(rows: DataFrame, key: Column, path: str, folder: str | None = None) -> DataFrame:
    """The rows whose key the index does not hold; all of them if there is no index yet."""
    spark = rows.sparkSession
    if not hadoop.exists(spark, f"{path}/keys"):
        return rows
    chunks = spark.read.parquet(f"{path}/buckets").first().chunks
    known = bloom.combined(spark.read.parquet(f"{path}/filter"))
    keyed = rows.withColumn("__key", key_text(key))
    probed = stage_table(bloom.with_maybe(keyed, F.col("__key"), known, "__maybe", chunks), folder)
    old = spark.table(_table(spark, path)).select(F.col("key").alias("__key"))
    doubtful = probed.where("__maybe").join(old, "__key", "left_anti")
    return probed.where("NOT __maybe").select(*rows.columns).unionByName(doubtful.select(*rows.columns))
