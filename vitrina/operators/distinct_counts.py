"""Posting reports over many snapshots whose distinct companies are merged, not counted again.

A dictionary gives every company a number, in order of arrival and without gaps. A snapshot leaves, for every group of every report, its
count of postings and bitmaps of the numbers of its companies (32,768 numbers each). Bitmaps of several snapshots are united bit by
bit and counted, which is exact; rows of earlier snapshots are never read again, and what is read grows with groups and companies.

Folder: `companies/` (the dictionary, a part per snapshot that brought new ones) and `groups/snapshot=<name>` (the bitmaps). A snapshot
that is added again replaces its groups and changes nothing else. One writer at a time.

Defined cases: NULL companies do not count, as in count(distinct); groups without companies have 0; a snapshot without rows leaves no
groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrina.operators import ranks
from vitrina.sources import hadoop
from vitrina.sources.staging import run_folder, stage_table

BITMAP = 32_768
REPORTS = {
    "posting_age": ("categoria_fecha",),
    "experience": ("nivel_experiencia_limpio",),
    "modality_location": ("modalidad_limpia", "ubicacion"),
}
_KEYS = ("key_1", "key_2")
_GROUPS = "report string, key_1 string, key_2 string, bucket long, postings long, bits binary, snapshot string"


def _dictionary(spark: SparkSession, path: str) -> DataFrame:
    if not hadoop.exists(spark, f"{path}/companies"):
        return spark.createDataFrame([], "company string, number long")
    return spark.read.schema("company string, number long").parquet(f"{path}/companies")


def add_companies(companies: DataFrame, path: str, folder: str | None = None) -> None:
    """Give the companies (one column `company`) that the dictionary does not hold the next numbers."""
    spark = companies.sparkSession
    known = _dictionary(spark, path)
    new = stage_table(companies.where("company IS NOT NULL").distinct().join(known, "company", "left_anti"), folder)
    if new.isEmpty():
        return
    taken = known.agg(F.max("number")).first()[0]
    placed = ranks.with_place(new, ("company",), "number", folder)
    next_number = 0 if taken is None else taken + 1
    placed.select("company", (F.col("number") + next_number).alias("number")).write.mode("append").parquet(f"{path}/companies")


def add_snapshot(postings: DataFrame, path: str, snapshot: str) -> None:
    """Add the cleaned postings of one snapshot; a name that was added before is replaced."""
    spark = postings.sparkSession
    with run_folder(spark) as folder:
        keys = sorted({key for names in REPORTS.values() for key in names})
        rows = stage_table(postings.select(*keys, "titulo_puesto", F.col("empresa").alias("company")), folder)
        add_companies(rows.select("company"), path, folder)
        numbered = rows.join(_dictionary(spark, path), "company", "left")
        # One group per report: a row goes through one aggregate for all of them, combined before the shuffle.
        reports = F.array(*[
            F.struct(F.lit(report).alias("report"), *[(F.col(names[k]) if k < len(names) else F.lit(None)).cast("string").alias(key) for k, key in enumerate(_KEYS)])
            for report, names in REPORTS.items()
        ])
        grouped = numbered.select(F.explode(reports).alias("group"), "number", "titulo_puesto").select("group.*", "number", "titulo_puesto")
        groups = grouped.groupBy("report", *_KEYS, F.coalesce(F.floor(F.col("number") / BITMAP), F.lit(-1)).alias("bucket")).agg(
            F.count("titulo_puesto").alias("postings"), F.bitmap_construct_agg(F.col("number") % BITMAP).alias("bits")
        )
        groups.write.mode("overwrite").parquet(f"{path}/groups/snapshot={snapshot}")


def merged_report(spark: SparkSession, path: str, report: str) -> DataFrame:
    """The report `posting_age`, `experience` or `modality_location` over all snapshots added so far."""
    names = REPORTS[report]
    groups = spark.read.schema(_GROUPS).parquet(f"{path}/groups").where(F.col("report") == report)
    if report == "modality_location":
        groups = groups.where("key_2 IS NOT NULL")
    united = groups.groupBy(*_KEYS, "bucket").agg(F.sum("postings").alias("postings"), F.bitmap_or_agg("bits").alias("bits"))
    companies = F.when(F.col("bucket") >= 0, F.bitmap_count("bits")).otherwise(0)
    counts = united.groupBy(*_KEYS).agg(F.sum("postings").alias("cantidad_empleos"), F.sum(companies).alias("empresas_unicas"))
    counts = counts.select(*[F.col(key).alias(name) for key, name in zip(_KEYS, names)], "cantidad_empleos", "empresas_unicas")
    return counts.orderBy(*names) if report == "posting_age" else counts.orderBy(F.desc("cantidad_empleos"), *names)
