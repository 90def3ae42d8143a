"""End-to-end runs: snapshots to reports, and stored pages to a validated snapshot."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from vitrina.operators import enrich, extract, ingest
from vitrina.plans import clean, reports
from vitrina.sources import sinks, snapshots, staging


Report = Callable[[DataFrame, DataFrame], DataFrame]


def all_reports(
    listings: DataFrame, postings: DataFrame, as_of: str | None = None, folder: str | None = None,
    more: Mapping[str, Report] | None = None,
) -> dict[str, DataFrame]:
    """The seven reports, from cleaned listings and postings, and `more` of the caller's own.

    The groups of all grouped reports are computed in one pass over each input and staged; ranking and median read the listings
    again. A report of `more` gets both cleaned tables.
    """
    listed = staging.stage_table(reports.listing_groups(listings), folder)
    posted = staging.stage_table(reports.posting_groups(postings), folder)
    prepared = {
        "productos_por_rango_precio": reports.price_band_of(listed),
        "productos_por_vendedor": reports.vendor_of(listed),
        "productos_por_factor_personalizado": reports.report_value_ranking(listings),
        "empleos_por_fecha_publicacion": reports.posting_age_of(posted),
        "empleos_por_nivel_experiencia": reports.experience_of(posted),
        "empleo_por_factor_personalizado_modalidad_ubicacion": reports.modality_location_of(posted),
        "reporte_resumen": reports.summary_of(listed, posted, listings, as_of, folder),
    }
    taken = sorted(prepared.keys() & (more or {}).keys())
    if taken:
        raise ValueError(f"reports of these names exist: {', '.join(taken)}")
    return prepared | {name: report(listings, postings) for name, report in (more or {}).items()}


def run_all(
    listings: DataFrame, postings: DataFrame, as_of: str | None = None, staged: bool = False, folder: str | None = None,
    more: Mapping[str, Report] | None = None, nulled: bool = False,
) -> dict[str, DataFrame]:
    """Clean both snapshots and prepare all reports.

    `staged` writes the cleaned columns once to the shared folder (or to `folder` in it), so that grouped reports, ranking and
    median do not parse CSV text again; without it they scan their input anew, which is right for columnar input. With `more`, all
    cleaned columns are staged.
    """
    cleaned, dated = clean.clean_listings(listings, nulled=nulled), clean.clean_postings(postings, as_of, nulled=nulled)
    if not more:
        cleaned = cleaned.select(*reports.RANKING_COLUMNS, "rango_precio")
        dated = dated.select(
            "titulo_puesto", "empresa", "ubicacion", "categoria_fecha", "nivel_experiencia_limpio", "modalidad_limpia"
        )
    if staged:
        cleaned, dated = staging.stage_table(cleaned, folder), staging.stage_table(dated, folder)
    return all_reports(cleaned, dated, as_of, folder, more)


def run_analysis(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str,
    listing_prefix: str = "listings_",
    posting_prefix: str = "postings_",
    as_of: str | None = None,
    multi_line: bool = True,
    more: Mapping[str, Report] | None = None,
) -> dict[str, str]:
    """Newest snapshot of each kind to seven written reports and `more`; returns their paths. Leaves nothing else behind."""
    listings = snapshots.scan_listings(
        spark, snapshots.latest_snapshot(spark, raw_dir, listing_prefix), multi_line
    )
    postings = snapshots.scan_postings(
        spark, snapshots.latest_snapshot(spark, raw_dir, posting_prefix), multi_line
    )
    with staging.run_folder(spark) as folder:
        prepared = run_all(listings, postings, as_of, True, folder, more, nulled=True)
        return sinks.write_reports(prepared, out_dir)


def listing_cards(
    pages: DataFrame, terms: Sequence[str], host: str, as_of: str | None = None, max_rows: int | None = None,
    blocks_per_page: int | None = None, seen: Observation | None = None, dropped: Observation | None = None,
) -> DataFrame:
    """Cards of stored result pages, numbered by term and capped; duplicates still in."""
    cards = extract.extract_listings(pages, host, as_of, max_rows, blocks_per_page=blocks_per_page, seen=seen)
    rows = ingest.number_terms(cards, "categoria", terms, dropped)
    return ingest.cap_per_term(rows, "categoria", ("page_id", "pos"), max_rows)


def posting_cards(
    pages: DataFrame, terms: Sequence[str], host: str, as_of: str | None = None, max_rows: int | None = None,
    seen: Observation | None = None, dropped: Observation | None = None,
) -> DataFrame:
    """Cards of stored posting pages, numbered by term and capped; duplicates still in."""
    rows = ingest.number_terms(extract.extract_postings(pages, host, as_of, max_rows, seen), "term", terms, dropped)
    return ingest.cap_per_term(rows, "term", ("page_id", "pos"), max_rows)


RUN_SCHEMA = (
    "kind string, rows_extracted bigint, duplicates_dropped bigint, rows_unique bigint, rows_valid bigint, "
    "success boolean, duration_s double, path string, error string, pages bigint, pages_blocked bigint, pages_thin bigint, "
    "rows_other_terms bigint, category_counts map<string, bigint>"
)
NO_ROWS = "no rows extracted"


def _session(spark, kind, extracted, terms, term, finish, export, out_dir, prefix, stamp, fmt) -> DataFrame:
    """One row about a run. An error of the run is a row too: success is false, `error` says why, counts not reached are NULL.

    All counts ride on the two jobs that write the cards and the snapshot. Pages without any record count as blocked or thin by
    their text; rows of terms that were not asked for are left out and counted; category_counts has the unique rows of every term.
    """
    started = time.time()
    row = dict.fromkeys(name.split()[0] for name in RUN_SCHEMA.replace("map<string, bigint>", "map").split(", ")) | {"kind": kind, "success": False}
    seen, kept, dropped, unique, written = (Observation(f"{kind} {what}") for what in ("pages", "kept", "dropped", "unique", "written"))
    try:
        with staging.run_folder(spark) as folder:
            # Pages are parsed once: all later steps, some of which read the cards twice, start from the staged table.
            cards = extracted(seen, dropped).observe(kept, F.count(F.lit(1)).alias("rows"))
            staged = staging.stage_table(cards, folder)
            row |= seen.get | dropped.get | {"rows_extracted": kept.get["rows"]}
            counts = [F.count_if(F.col(term) == name).alias(f"c{k}") for k, name in enumerate(terms)]
            path = export(finish(staged, folder).observe(unique, *counts), out_dir, prefix, stamp, written, staged, fmt)
            got = written.get if path else {"rows_in": 0, "rows_valid": 0}
            categories = {name: unique.get[f"c{k}"] for k, name in enumerate(terms)} if path else {}
            row |= {
                "duplicates_dropped": row["rows_extracted"] - got["rows_in"], "rows_unique": got["rows_in"], "rows_valid": got["rows_valid"],
                "path": path, "success": path is not None, "error": None if path else NO_ROWS,
                "category_counts": {name: count for name, count in categories.items() if count},
            }
    except Exception as error:  # a failed run is a result, whatever failed
        row["error"] = f"{type(error).__name__}: {error}"[:2000]
    row["duration_s"] = time.time() - started
    return spark.createDataFrame([tuple(row.values())], RUN_SCHEMA)


def run_listing_session(
    pages: DataFrame,
    detail_pages: DataFrame | None,
    terms: Sequence[str],
    host: str,
    out_dir: str,
    as_of: str | None = None,
    max_rows: int | None = None,
    prefix: str = "listings_",
    stamp: str | None = None,
    blocks_per_page: int | None = None,
    per_term: int | None = None,
    fmt: str = "csv",
) -> DataFrame:
    """Pages to a written listing snapshot; one row with the counts, the path and the duration of the run.

    Details (from stored `detail_pages` with url, html, fetched_at) apply before deduplication, to the first `per_term` rows of
    every term (only their pages are parsed), or to all. `max_rows` caps a page and a term, `blocks_per_page` the blocks looked at;
    None, the default, means no cap. `fmt` is csv or parquet.
    """

    def finish(cards: DataFrame, folder: str) -> DataFrame:
        place = ("page_id", "pos")
        if detail_pages is not None:
            cards = enrich.enrich_listings(
                cards, detail_pages, "categoria", place, per_term, extract.listing_detail_updates, folder
            )
        return ingest.dedup_listings(cards, ("term_no", *place))

    def extracted(seen: Observation, dropped: Observation) -> DataFrame:
        return listing_cards(pages, terms, host, as_of, max_rows, blocks_per_page, seen, dropped)

    return _session(pages.sparkSession, "listings", extracted, terms, "categoria", finish, sinks.export_listings, out_dir, prefix, stamp, fmt)


def run_posting_session(
    pages: DataFrame,
    detail_pages: DataFrame | None,
    terms: Sequence[str],
    host: str,
    out_dir: str,
    as_of: str | None = None,
    max_rows: int | None = None,
    prefix: str = "postings_",
    stamp: str | None = None,
    limit: int | None = None,
    fmt: str = "csv",
) -> DataFrame:
    """Pages to a written posting snapshot, csv or parquet. Details apply after deduplication, to the first `limit` rows overall (None: all)."""

    def finish(cards: DataFrame, folder: str) -> DataFrame:
        place = ("term_no", "page_id", "pos")
        rows = ingest.dedup_postings(cards, place)
        if detail_pages is None:
            return rows
        return enrich.enrich_postings(rows, detail_pages, place, limit, extract.posting_detail, folder)

    def extracted(seen: Observation, dropped: Observation) -> DataFrame:
        return posting_cards(pages, terms, host, as_of, max_rows, seen, dropped)

    return _session(pages.sparkSession, "postings", extracted, terms, "term", finish, sinks.export_postings, out_dir, prefix, stamp, fmt)


def run_metrics(listings: DataFrame, order_by: Sequence[str] = ("term_no", "pos")) -> DataFrame:
    """Counts of a run as a query: rows in, unique rows, rows that pass validation, duplicates dropped."""
    exported = clean.export_listing_rows(ingest.dedup_listings(listings, order_by))
    valid = ingest.valid_listing(F.col("producto"), F.col("precio"))
    unique = exported.agg(F.count("*").alias("rows_unique"), F.count_if(valid).alias("rows_valid"))
    return (
        listings.agg(F.count("*").alias("rows_in"))
        .crossJoin(F.broadcast(unique))
        .withColumn("duplicates_dropped", F.col("rows_in") - F.col("rows_unique"))
    )
