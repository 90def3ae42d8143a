"""Shape of the plans: what makes them hold on large inputs."""

import pytest

from checks import sample_tables as st
from checks.queries import QUERIES, _numbered
from vitrina.operators import enrich, ingest

SF = "/root/testdata/sf0.001"
FROM_HTML = {
    "extract_containers", "container_text_filter", "first_match_text", "attribute_extract", "presence_flag", "extract_listings",
    "extract_postings", "absolutize_url", "posting_detail", "listing_detail", "page_status_html", "run_listing_session",
    "run_posting_session", "extract_containers_capped", "container_text_filter_capped", "extract_listings_capped",
    "extract_postings_capped", "run_listing_session_capped", "run_posting_session_capped", "run_listing_session_counts",
    "run_posting_session_counts", "run_session_failed",
}
WRITING = {"ingest_new_snapshots", "scan_listings", "scan_listings_one_file", "scan_listings_reordered", "scan_postings", "latest_snapshot", "export_listings", "export_postings", "write_reports"}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FROM_HTML - WRITING))
def test_no_python_and_no_cartesian_work(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Python" not in text and "Pandas" not in text and "InArrow" not in text
    assert "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["dedup_listings", "dedup_postings", "cap_per_term", "enrich_listings_all"])
def test_groups_are_cut_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "WindowGroupLimit" in text and "Partial" in text and "SinglePartition" not in text


def test_large_caps_filter_before_the_shuffle(spark):
    rows = spark.range(50_000).selectExpr("id % 2 AS term", "id AS pos")
    text = plan(ingest.cap_per_term(rows, "term", ("pos",), 2000))
    window = text.index("Window [")
    assert text.count("Window [") == 1 and text.index("Filter", window) < text.index("Range", window) and "SinglePartition" not in text


def test_single_tasks_see_only_bounded_rows(spark):
    # No window without partitions at all; the median's are over the digits of its two ranks.
    for name in set(QUERIES) - FROM_HTML - WRITING:
        text = plan(QUERIES[name](spark, SF))
        for line in text.splitlines():
            if "Window [" in line:
                assert "], [" in line, (name, line)


@pytest.mark.parametrize("name", ["rank_sort", "report_value_ranking_placed"])
def test_places_need_no_single_task(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "SinglePartition" not in text and "Window" not in text and "Coalesce" not in text


def test_top_rows_need_no_sort_of_everything(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["report_value_ranking_top"](spark, SF))
    chosen = enrich.chosen_postings(ingest.dedup_postings(_numbered(spark, SF), st.POSTING_ORDER), st.POSTING_ORDER, 20)
    assert "TakeOrderedAndProject" in plan(chosen)


@pytest.mark.parametrize("name", ["enrich_listings", "enrich_postings"])
def test_few_updates_do_not_shuffle_the_table(spark, name):
    text = plan(QUERIES[name](spark, SF))
    top = text.split("Window")[0]  # the posting table itself comes out of a deduplication
    assert "BroadcastHashJoin" in top and "SortMergeJoin" not in text
    assert "Exchange hashpartitioning(coalesce" not in text


def test_groups_are_cut_before_the_shuffle_for_the_chosen(spark):
    text = plan(enrich.chosen_listings(st.raw_listings(spark, SF), "categoria", st.LISTING_ORDER, 8))
    assert "WindowGroupLimit" in text and "Partial" in text and "l_extendedprice" in text and "l_tax" not in text


def test_scans_read_only_what_a_report_needs(spark):
    text = plan(QUERIES["report_vendor"](spark, SF))
    assert "l_discount" not in text and "l_shipdate" not in text and "p_type" not in text
    lineitem = st.table(spark, SF, "lineitem")
    assert len(lineitem.columns) == 11


def test_only_wanted_pages_are_parsed_without_a_limit(spark):
    from vitrina.operators import extract

    pages = spark.range(2000).selectExpr(
        "concat('https://x.example.com/', id) AS url", "concat('<body><h1>t</h1><p>', id, '</p></body>') AS html", "1 AS fetched_at"
    )
    rows = st.raw_listings(spark, SF).limit(20).selectExpr("* EXCEPT (url_producto)", "concat('https://x.example.com/', orden_1 % 10) AS url_producto")
    wanted = {r.url_producto for r in rows.collect()}
    kept = {r.url for r in enrich.of_wanted(pages, rows, "url_producto").collect()}
    assert wanted & {f"https://x.example.com/{k}" for k in range(10)} <= kept and len(kept) < 30
    text = plan(enrich.enrich_listings(rows, pages, "categoria", st.LISTING_ORDER, None, extract.listing_detail_updates))
    parsed = text.index("MapInArrow")
    assert "bitmap_construct_agg" in text[parsed:] and "BroadcastHashJoin" in text[parsed:]
