"""Names and removal of files through Hadoop's file systems, so that any store Spark can read works."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, path: str):
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()), target


def list_folder(spark: SparkSession, path: str) -> list[tuple[str, str, bool, int]]:
    """(name, full path, is a folder, modification time in ms) of what lies directly in a folder."""
    system, target = _resolve(spark, path)
    return [
        (s.getPath().getName(), s.getPath().toString(), s.isDirectory(), s.getModificationTime())
        for s in system.listStatus(target)
    ]


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _resolve(spark, path)
    return system.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    system, target = _resolve(spark, path)
    system.delete(target, True)
