"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from vitrina.sources import hadoop


def shared_root(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names, or the session's checkpoint folder.

    Where neither is set, a local master may use the warehouse folder; a cluster must name a folder, since its machines
    share no local one.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root and context.master.split("[")[0] == "local":
        root = spark.conf.get("spark.sql.warehouse.dir")
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the shared root."""
    return f"{shared_root(spark)}/vitrina-{uuid.uuid4().hex}"


def stage_table(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """Cut the lineage: write the rows once as Parquet in the shared folder and read them back.

    The table outlives lost executors, its columns can be pruned, and its size is known when a join with it is planned.
    Tables in a `run_folder` go when the run ends; others are left to the cluster's clean-up of the shared folder.
    """
    spark = rows.sparkSession
    path = f"{folder or shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A shared folder that lasts as long as the block."""
    folder = shared_folder(spark)
    try:
        yield folder
    finally:
        hadoop.delete(spark, folder)
