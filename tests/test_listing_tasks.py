"""Listings derived in tasks of bounded rows; a join that shuffles uses the same partitions."""

import glob
import re

import pytest

from checks import queries, sample_tables as st
from vitrina.operators import ingest


@pytest.fixture
def tables(spark, tmp_path):
    spark.sql(
        "SELECT id AS l_orderkey, id % 7 AS l_partkey, id % 3 AS l_suppkey, CAST(id % 4 + 1 AS INT) AS l_linenumber, 10.5D + id AS l_extendedprice, "
        "'A' AS l_returnflag, 'O' AS l_linestatus, timestamp'2024-01-01' AS l_shipdate FROM range(40)"
    ).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT id AS p_partkey, 'mesa' AS p_name, 'Brand#1' AS p_brand, 'TIN' AS p_type FROM range(7)").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("SELECT id AS s_suppkey, 'S' AS s_name, 3 AS s_nationkey FROM range(3)").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def test_listings_in_bounded_tasks(spark, tables, monkeypatch):
    whole = sorted(map(str, st.raw_listings(spark, tables).collect()))
    monkeypatch.setattr(st, "LISTINGS_PER_TASK", 10)
    dealt = st.raw_listings(spark, tables)
    assert dealt.rdd.getNumPartitions() == 4 and sorted(map(str, dealt.collect())) == whole and len(whole) == 40
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # lineitem is shuffled once, also where the join with part shuffles
        plan = ingest.cap_per_term(st.raw_listings(spark, tables), "categoria", st.LISTING_ORDER, 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(l_partkey") == 1


def test_the_code_of_a_scored_row_can_be_compiled(spark, tables, capsys):
    """The JVM interprets methods above 8,000 bytes, several times as slowly."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        queries.value_score(spark, tables).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_a_large_file_is_written_by_several_tasks(spark, tables, tmp_path, monkeypatch):
    whole = sorted(map(str, queries.scan_listings_one_file(spark, tables).collect()))
    folder = f"{tmp_path}/shared"
    monkeypatch.setattr(queries.staging, "shared_folder", lambda spark: folder)
    monkeypatch.setattr(st, "LISTINGS_PER_TASK", 5)
    monkeypatch.setattr(queries, "LARGE_FILE_ROWS", 20)
    assert sorted(map(str, queries.scan_listings_one_file(spark, tables).collect())) == whole and len(whole) == 40
    assert len(glob.glob(f"{folder}/listings.csv/*.csv")) == 2
