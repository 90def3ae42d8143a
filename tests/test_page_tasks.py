"""Rendered pages are dealt out over tasks before they are rendered, however small the file of their rows is."""

import pytest

from checks import sample_tables as st
from vitrina.operators import extract

ROWS = {
    "part": "SELECT id AS p_partkey, concat('parte ', id) AS p_name, 'Brand#1' AS p_brand, 'PROMO TIN' AS p_type, CAST(id % 5 + 1 AS INT) AS p_size FROM range(9)",
    "customer": "SELECT id AS c_custkey, concat('Customer ', id) AS c_name, 3 AS c_nationkey, 'BUILDING' AS c_mktsegment FROM range(9)",
    "orders": "SELECT id AS o_orderkey, id AS o_custkey, 'F' AS o_orderstatus, 10.5D AS o_totalprice, timestamp'2024-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(9)",
    "events": "SELECT id AS event_id, timestamp'2024-01-01' AS ts, id AS user_id, 'click' AS event_type, 'p' AS props FROM range(9)",
}
PAGES = {
    "part": ("LISTING_PAGES", st.listing_pages, "RESULT_PAGES_PER_TASK"),
    "customer": ("POSTING_PAGES", st.posting_pages, "RESULT_PAGES_PER_TASK"),
    "orders": ("LISTING_DETAIL_PAGES", st.listing_detail_pages, "DETAIL_PAGES_PER_TASK"),
    "events": ("POSTING_DETAIL_PAGES", st.posting_detail_pages, "DETAIL_PAGES_PER_TASK"),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_tasks_grow_with_the_pages(spark, tmp_path, monkeypatch, name):
    spark.sql(ROWS[name]).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    text, pages, limit = PAGES[name]
    monkeypatch.setattr(st, limit, 2)
    found = pages(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 5
    assert sorted(found.collect()) == sorted(st.derive(spark, str(tmp_path), getattr(st, text), name).collect())
    if name == "part":  # parsing stays in the tasks that render
        plan = extract.extract_listings(found, st.LISTING_HOST, st.AS_OF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.index("MapInArrow") < plan.index("Exchange")
