"""One query per operator, each over whole given tables or tables derived from them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import sample_tables as st
from vitrina import fixed_values as fv
from vitrina.functions import labels, text
from vitrina.functions.dates import age_band, as_of_column, parse_posted_at
from vitrina.functions.prices import PRICE_BANDS_SIX, parse_price, price_band
from vitrina.operators import distinct_counts, enrich, extract, ingest
from vitrina.plans import clean, reports, run
from vitrina.schemas import LISTING_SCHEMA
from vitrina.sources import sinks, snapshots, staging
from vitrina.streaming import new_snapshots

SNAPSHOT_BY = st.LISTING_ORDER[1]
LARGE_FILE_ROWS = 2_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _pages(spark, sf_dir):
    return st.result_pages(spark, sf_dir)


def _listings(spark, sf_dir):
    return clean.clean_listings(st.raw_listings(spark, sf_dir))


def _postings(spark, sf_dir):
    return clean.clean_postings(st.raw_postings(spark, sf_dir), st.AS_OF)


def _numbered(spark, sf_dir):
    return ingest.number_terms(st.raw_postings(spark, sf_dir), "term", st.POSTING_TERMS)


# --- scans, sources, sinks -----------------------------------------------------------------------------------------------


@query
def scan_listings(spark, sf_dir):
    path = f"{staging.shared_folder(spark)}/listings.csv"
    sinks.write_csv(st.raw_listings(spark, sf_dir).select(*fv.LISTING_COLUMNS), path)
    return snapshots.scan_listings(spark, path)


@query
def scan_listings_reordered(spark, sf_dir):
    path = f"{staging.shared_folder(spark)}/listings.csv"
    rows = st.raw_listings(spark, sf_dir).select(F.lit("más").alias("extra"), *reversed(fv.LISTING_COLUMNS))
    sinks.write_csv(rows, path)
    return snapshots.scan_listings(spark, path)


@query
def scan_listings_one_file(spark, sf_dir):
    """One file, as other programs leave it, with line breaks and quotes in a value of every second row.

    A file has one writer, so above `LARGE_FILE_ROWS` there are several, each still many byte ranges long.
    """
    path = f"{staging.shared_folder(spark)}/listings.csv"
    broken = F.when(F.col(SNAPSHOT_BY) % 2 == 0, F.concat("producto", F.lit('\n"línea"\n'), "categoria")).otherwise(F.col("producto"))
    rows = st.raw_listings(spark, sf_dir).withColumn("producto", broken).select(*fv.LISTING_COLUMNS)
    files = max(1, -(-st.table(spark, sf_dir, "lineitem").count() // LARGE_FILE_ROWS))
    sinks.write_csv(rows.coalesce(files), path, records_per_file=0)  # the case itself: files that no Spark job cut
    return snapshots.scan_large_snapshot(spark, path, LISTING_SCHEMA)


@query
def scan_postings(spark, sf_dir):
    path = f"{staging.shared_folder(spark)}/postings.csv"
    sinks.write_csv(st.raw_postings(spark, sf_dir).select(*fv.POSTING_COLUMNS), path)
    return snapshots.scan_postings(spark, path)


@query
def ingest_new_snapshots(spark, sf_dir):
    """Three snapshots: one there at the first run of the stream, two more at the second, nothing new at the third."""
    folder = staging.shared_folder(spark)
    rows = st.raw_listings(spark, sf_dir)

    def arrive(number: int) -> None:
        part = rows.where(F.pmod(F.col(SNAPSHOT_BY), F.lit(3)) == number).select(*fv.LISTING_COLUMNS)
        sinks.write_snapshot(part, f"{folder}/raw/listings_{number}.csv")

    def ingest_now() -> int:
        return new_snapshots.ingest_new_snapshots(
            spark, f"{folder}/raw", "listings_", LISTING_SCHEMA, f"{folder}/table", f"{folder}/checkpoint", files_per_batch=8
        )

    arrive(0)
    ingest_now()
    arrive(1)
    arrive(2)
    ingest_now()
    ingest_now()
    return new_snapshots.ingested(spark, LISTING_SCHEMA, f"{folder}/table")


@query
def latest_snapshot(spark, sf_dir):
    folder = staging.shared_folder(spark)
    rows = st.raw_listings(spark, sf_dir).select(*fv.LISTING_COLUMNS)
    sinks.write_csv(rows.where("disponible = 'No'"), f"{folder}/listings_2.csv")
    sinks.write_csv(rows, f"{folder}/listings_1.csv")
    newest = snapshots.latest_snapshot(spark, folder, "listings_")
    counts = snapshots.scan_listings(spark, newest).groupBy("categoria").agg(F.count("*").alias("n"))
    return counts.withColumn("snapshot", F.lit(newest.rsplit("/", 1)[1]))


@query
def export_listings(spark, sf_dir):
    folder = staging.shared_folder(spark)
    path = sinks.export_listings(st.raw_listings(spark, sf_dir), folder, stamp="20240201_120000")
    return spark.read.schema(snapshots.LISTING_SCHEMA).csv(path, header=True, quote='"', escape='"', multiLine=True)


@query
def export_postings(spark, sf_dir):
    folder = staging.shared_folder(spark)
    path = sinks.export_postings(st.raw_postings(spark, sf_dir), folder, stamp="20240201_120000")
    return spark.read.schema(snapshots.POSTING_SCHEMA).csv(path, header=True, quote='"', escape='"', multiLine=True)


def _report_values(frames, types) -> DataFrame:
    """Every number of every row of the reports: report, row_key (the texts and flags of the row), name, value."""

    def values(name: str) -> DataFrame:
        numbers = [column for column, kind in types[name] if kind in ("bigint", "double")]
        texts = [F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("-")) for column, _ in types[name] if column not in numbers]
        cells = [F.struct(F.lit(column).alias("name"), F.col(column).cast("double").alias("value")) for column in numbers]
        return frames[name].select(F.lit(name).alias("report"), F.concat_ws("|", *texts).alias("row_key"), F.inline(F.array(*cells)))

    return reduce(DataFrame.unionByName, map(values, frames))


@query
def write_reports(spark, sf_dir):
    prepared = run.run_all(st.raw_listings(spark, sf_dir), st.raw_postings(spark, sf_dir), st.AS_OF, staged=True)
    paths = sinks.write_reports(prepared, staging.shared_folder(spark))
    read = {name: spark.read.csv(path, header=True, escape='"', multiLine=True) for name, path in paths.items()}
    return _report_values(read, {name: report.dtypes for name, report in prepared.items()})


@query
def scan_pages(spark, sf_dir):
    return _pages(spark, sf_dir)


# --- extraction from pages -----------------------------------------------------------------------------------------------


@query
def extract_containers(spark, sf_dir):
    found = extract.extract_containers(_pages(spark, sf_dir), (".results li", "nav ul li", "p"))
    return found.select("page_id", "pos", "content")


@query
def extract_containers_capped(spark, sf_dir):
    found = extract.extract_containers(_pages(spark, sf_dir), (".results li", "nav ul li", "p"), limit=4)
    return found.select("page_id", "pos", "content")


@query
def container_text_filter(spark, sf_dir):
    found = extract.extract_containers(_pages(spark, sf_dir), ("article h2", "article p"))
    return found.where(extract.is_listing_block(F.col("content"))).select("page_id", "pos", "content")


@query
def container_text_filter_capped(spark, sf_dir):
    found = extract.extract_containers(
        _pages(spark, sf_dir), ("article h2", "article p"), limit=fv.LISTING_BLOCKS_PER_PAGE
    )
    return found.where(extract.is_listing_block(F.col("content"))).select("page_id", "pos", "content")


@query
def listing_block_text(spark, sf_dir):
    documents = st.table(spark, sf_dir, "documents")
    return documents.select("doc_id", extract.is_listing_block(F.col("text")).alias("usable"))


@query
def first_match_text(spark, sf_dir):
    return extract.first_match_text(_pages(spark, sf_dir), ("article h2", "title", "h1"))


@query
def attribute_extract(spark, sf_dir):
    return extract.attribute_extract(_pages(spark, sf_dir), "nav a[href]", "href")


@query
def presence_flag(spark, sf_dir):
    return extract.presence_flag(_pages(spark, sf_dir), ("time", 'nav a[href*="tion"]'))


@query
def extract_listings(spark, sf_dir):
    return extract.extract_listings(st.listing_pages(spark, sf_dir), st.LISTING_HOST, st.AS_OF)


@query
def extract_listings_capped(spark, sf_dir):
    return extract.extract_listings(
        st.listing_pages(spark, sf_dir), st.LISTING_HOST, st.AS_OF, fv.ROWS_PER_TERM, blocks_per_page=fv.LISTING_BLOCKS_PER_PAGE
    )


@query
def extract_postings(spark, sf_dir):
    return extract.extract_postings(st.posting_pages(spark, sf_dir), st.POSTING_HOST, st.AS_OF)


@query
def extract_postings_capped(spark, sf_dir):
    return extract.extract_postings(st.posting_pages(spark, sf_dir), st.POSTING_HOST, st.AS_OF, fv.ROWS_PER_TERM)


@query
def absolutize_url(spark, sf_dir):
    spec = extract.Spec((extract.Field("hrefs", ("a[href]",), "href", every=True),))
    found = extract.extract_records(_pages(spark, sf_dir), spec)
    links = found.select("page_id", F.posexplode(F.get("blocks", F.lit(0))["hrefs"]).alias("pos", "href"))
    return links.select(
        "page_id", "pos", "href",
        text.absolute_listing_url(F.col("href"), st.LISTING_HOST).alias("listing_url"),
        text.absolute_posting_url(F.col("href"), st.POSTING_HOST).alias("posting_url"),
    )


@query
def company_pick(spark, sf_dir):
    rows = st.raw_postings(spark, sf_dir)
    return rows.select(
        "pos", labels.pick_company(F.array("ubicacion", F.lit("  "), "modalidad", "empresa")).alias("empresa_elegida")
    )


@query
def location_predicate(spark, sf_dir):
    documents = st.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text"))
    places = st.raw_postings(spark, sf_dir).select(F.col("pos").alias("id"), F.col("ubicacion").alias("text"))
    return documents.unionAll(places).select("id", labels.is_location(F.col("text")).alias("is_location"))


@query
def location_and_mode(spark, sf_dir):
    place = F.concat_ws("\n \t", "ubicacion", "modalidad")
    return st.raw_postings(spark, sf_dir).select(
        "pos", labels.location_text(place).alias("ubicacion"), labels.location_mode(place).alias("modalidad")
    )


@query
def snippet(spark, sf_dir):
    return st.table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query
def posting_detail(spark, sf_dir):
    return extract.posting_detail(st.posting_detail_pages(spark, sf_dir))


@query
def level_pick(spark, sf_dir):
    candidates = F.array("modalidad", F.concat(F.lit(' "'), F.col("nivel_experiencia"), F.lit("\"\n de 'planta' ")), "titulo_puesto")
    return st.raw_postings(spark, sf_dir).select("pos", labels.pick_level(candidates).alias("nivel"))


@query
def listing_detail(spark, sf_dir):
    return extract.listing_detail(st.listing_detail_pages(spark, sf_dir))


@query
def posting_date_pick(spark, sf_dir):
    rows = st.raw_postings(spark, sf_dir).withColumns(
        {
            "attr": F.when(F.col("pos") % 3 == 0, F.array("fecha_publicacion")).otherwise(F.array()),
            "shown": F.when(F.col("pos") % 3 < 2, F.array(F.concat(F.lit(" "), "fecha_publicacion"))).otherwise(F.array()),
        }
    )
    return rows.select("pos", labels.pick_posting_date(F.col("attr"), F.col("shown")).alias("fecha"))


@query
def page_status(spark, sf_dir):
    documents = st.table(spark, sf_dir, "documents")
    return documents.select("doc_id", labels.page_status(F.col("text")).alias("status"))


@query
def page_status_html(spark, sf_dir):
    return extract.page_statuses(_pages(spark, sf_dir))


# --- normalisers ---------------------------------------------------------------------------------------------------------


@query
def clean_text_listing(spark, sf_dir):
    return clean.export_listing_rows(st.raw_listings(spark, sf_dir)).drop("precio")


@query
def clean_text_posting(spark, sf_dir):
    return clean.export_posting_rows(st.raw_postings(spark, sf_dir))


@query
def clean_price_text(spark, sf_dir):
    rows = st.raw_listings(spark, sf_dir)
    return rows.select(*st.LISTING_ORDER, text.clean_price_text(F.col("precio")).alias("precio"))


@query
def valid_listing(spark, sf_dir):
    return clean.valid_listing_rows(clean.export_listing_rows(st.raw_listings(spark, sf_dir))).select("producto", "precio")


@query
def valid_posting(spark, sf_dir):
    rows = clean.valid_posting_rows(clean.export_posting_rows(st.raw_postings(spark, sf_dir)))
    return rows.select("titulo_puesto", "empresa", "url_empleo")


@query
def parse_valid_listing(spark, sf_dir):
    rows = st.raw_listings(spark, sf_dir)
    kept = rows.where(extract.parse_valid_listing(F.col("producto"), F.col("precio")))
    return kept.select("producto", "precio", *st.LISTING_ORDER)


@query
def parse_valid_posting(spark, sf_dir):
    rows = st.raw_postings(spark, sf_dir)
    return rows.where(extract.parse_valid_posting(F.col("titulo_puesto"), F.col("empresa"))).select("pos", "titulo_puesto")


@query
def parse_price_(spark, sf_dir):
    rows = st.raw_listings(spark, sf_dir)
    return rows.select(*st.LISTING_ORDER, "precio", parse_price(F.col("precio")).alias("precio_numerico"))


@query
def clean_vendor(spark, sf_dir):
    return _listings(spark, sf_dir).groupBy("vendedor", "vendedor_limpio").agg(F.count("*").alias("n"))


@query
def classify_reputation(spark, sf_dir):
    return _listings(spark, sf_dir).groupBy("reputacion_vendedor", "reputacion_limpia").agg(F.count("*").alias("n"))


@query
def flag_available(spark, sf_dir):
    return _listings(spark, sf_dir).groupBy("disponible", "disponible_bool").agg(F.count("*").alias("n"))


@query
def flag_free_shipping(spark, sf_dir):
    return _listings(spark, sf_dir).groupBy("envio_gratis", "envio_gratis_bool").agg(F.count("*").alias("n"))


@query
def parse_posted_at_(spark, sf_dir):
    return _postings(spark, sf_dir).select("pos", "fecha_publicacion", "fecha_publicacion_dt")


@query
def parse_posted_at_strict(spark, sf_dir):
    rows = clean.clean_postings(st.raw_postings(spark, sf_dir), st.AS_OF, strict_units=True)
    return rows.select("pos", "fecha_publicacion", "fecha_publicacion_dt")


@query
def parse_posted_at_documents(spark, sf_dir):
    moment = as_of_column(st.AS_OF)
    documents = st.table(spark, sf_dir, "documents")
    return documents.select("doc_id", parse_posted_at(F.col("text"), moment).alias("posted_at"))


@query
def classify_experience(spark, sf_dir):
    return _postings(spark, sf_dir).groupBy("nivel_experiencia", "nivel_experiencia_limpio").agg(F.count("*").alias("n"))


@query
def classify_modality(spark, sf_dir):
    return _postings(spark, sf_dir).groupBy("modalidad", "modalidad_limpia").agg(F.count("*").alias("n"))


@query
def title_case_documents(spark, sf_dir):
    documents = st.table(spark, sf_dir, "documents")
    return documents.select("doc_id", text.title_case(F.lower("text")).alias("titled"))


@query
def price_band_(spark, sf_dir):
    return _listings(spark, sf_dir).select(*st.LISTING_ORDER, "rango_precio")


@query
def price_band_six(spark, sf_dir):
    rows = _listings(spark, sf_dir)
    return rows.select(*st.LISTING_ORDER, price_band(F.col("precio_numerico"), PRICE_BANDS_SIX).alias("rango_precio"))


@query
def age_band_(spark, sf_dir):
    moment = as_of_column(st.AS_OF)
    orders = st.table(spark, sf_dir, "events")
    shifted = F.timestamp_add("DAY", F.lit(4), F.col("ts").cast("timestamp_ntz"))
    return orders.select("event_id", age_band(shifted, moment).alias("categoria_fecha"))


@query
def value_score(spark, sf_dir):
    return _listings(spark, sf_dir).select(*st.LISTING_ORDER, "puntaje_valor")


# --- joins ---------------------------------------------------------------------------------------------------------------


@query
def enrich_listings(spark, sf_dir):
    return enrich.enrich_listings(
        st.raw_listings(spark, sf_dir), st.listing_details(spark, sf_dir), "categoria", st.LISTING_ORDER,
        fv.ENRICHED_LISTINGS_PER_TERM,
    )


@query
def enrich_listings_recrawled(spark, sf_dir):
    # Every row twice, with the same place: as many rows leave as enter.
    rows = st.raw_listings(spark, sf_dir)
    return enrich.enrich_listings(
        rows.unionAll(rows), st.listing_details(spark, sf_dir), "categoria", st.LISTING_ORDER, per_term=None
    )


@query
def enrich_listings_all(spark, sf_dir):
    return enrich.enrich_listings(
        st.raw_listings(spark, sf_dir), st.listing_details(spark, sf_dir), "categoria", st.LISTING_ORDER, per_term=None
    )


@query
def enrich_postings(spark, sf_dir):
    unique = ingest.dedup_postings(_numbered(spark, sf_dir), st.POSTING_ORDER)
    return enrich.enrich_postings(unique, st.posting_details(spark, sf_dir), st.POSTING_ORDER)


@query
def enrich_postings_capped(spark, sf_dir):
    unique = ingest.dedup_postings(_numbered(spark, sf_dir), st.POSTING_ORDER)
    return enrich.enrich_postings(unique, st.posting_details(spark, sf_dir), st.POSTING_ORDER, fv.ENRICHED_POSTINGS)


# --- reports -------------------------------------------------------------------------------------------------------------


@query
def report_price_band(spark, sf_dir):
    return reports.report_price_band(_listings(spark, sf_dir))


@query
def report_vendor(spark, sf_dir):
    return reports.report_vendor(_listings(spark, sf_dir))


@query
def report_value_ranking(spark, sf_dir):
    return reports.report_value_ranking(_listings(spark, sf_dir))


@query
def report_value_ranking_placed(spark, sf_dir):
    return reports.report_value_ranking_placed(_listings(spark, sf_dir))


@query
def report_value_ranking_top(spark, sf_dir):
    return reports.report_value_ranking(_listings(spark, sf_dir), limit=100)


@query
def report_posting_age(spark, sf_dir):
    return reports.report_posting_age(_postings(spark, sf_dir))


@query
def report_experience(spark, sf_dir):
    return reports.report_experience(_postings(spark, sf_dir))


@query
def report_modality_location(spark, sf_dir):
    return reports.report_modality_location(_postings(spark, sf_dir))


def _merged(spark, sf_dir, report):
    """Three snapshots added one after the other; the report from what they left."""
    path = f"{staging.shared_folder(spark)}/companies"
    postings = _postings(spark, sf_dir)
    for number in range(3):
        distinct_counts.add_snapshot(postings.where(F.pmod("pos", F.lit(3)) == number), path, f"postings_{number}")
    return distinct_counts.merged_report(spark, path, report)


@query
def report_posting_age_merged(spark, sf_dir):
    return _merged(spark, sf_dir, "posting_age")


@query
def report_experience_merged(spark, sf_dir):
    return _merged(spark, sf_dir, "experience")


@query
def report_modality_location_merged(spark, sf_dir):
    return _merged(spark, sf_dir, "modality_location")


@query
def summary(spark, sf_dir):
    return reports.summary(_listings(spark, sf_dir), _postings(spark, sf_dir), st.AS_OF)


@query
def exact_median(spark, sf_dir):
    return reports.exact_median(st.table(spark, sf_dir, "lineitem"), "l_extendedprice")


@query
def category_counts(spark, sf_dir):
    return reports.category_counts(st.raw_listings(spark, sf_dir))


@query
def category_price_stats(spark, sf_dir):
    stats = reports.category_price_stats(_listings(spark, sf_dir))
    return stats.select("categoria", F.round("mean", 3).alias("mean"), "count", F.round("std", 3).alias("std"))


@query
def modality_distribution(spark, sf_dir):
    return reports.modality_distribution(st.raw_postings(spark, sf_dir))


@query
def average_price_simple(spark, sf_dir):
    average = reports.average_price_simple(st.raw_listings(spark, sf_dir))
    return average.select(F.round("precio_promedio", 4).alias("precio_promedio"))


@query
def run_all(spark, sf_dir):
    prepared = run.run_all(st.raw_listings(spark, sf_dir), st.raw_postings(spark, sf_dir), st.AS_OF)
    return _report_values(prepared, {name: report.dtypes for name, report in prepared.items()})


@query
def run_metrics(spark, sf_dir):
    return run.run_metrics(st.raw_listings(spark, sf_dir), st.LISTING_ORDER)


@query
def run_listing_session(spark, sf_dir):
    result = run.run_listing_session(
        st.listing_pages(spark, sf_dir), st.listing_detail_pages(spark, sf_dir),
        st.LISTING_TERMS, st.LISTING_HOST, staging.shared_folder(spark), st.AS_OF, stamp="20240201_120000",
    )
    return result.select("kind", "rows_extracted", "rows_unique", "duplicates_dropped", "rows_valid", "success")


@query
def run_listing_session_capped(spark, sf_dir):
    result = run.run_listing_session(
        st.listing_pages(spark, sf_dir), st.listing_detail_pages(spark, sf_dir),
        st.LISTING_TERMS, st.LISTING_HOST, staging.shared_folder(spark), st.AS_OF, fv.ROWS_PER_TERM, stamp="20240201_120000",
        blocks_per_page=fv.LISTING_BLOCKS_PER_PAGE, per_term=fv.ENRICHED_LISTINGS_PER_TERM,
    )
    return result.select("kind", "rows_extracted", "rows_unique", "duplicates_dropped", "rows_valid", "success")


@query
def run_posting_session(spark, sf_dir):
    result = run.run_posting_session(
        st.posting_pages(spark, sf_dir), st.posting_detail_pages(spark, sf_dir),
        st.SEGMENTS, st.POSTING_HOST, staging.shared_folder(spark), st.AS_OF, stamp="20240201_120000",
    )
    return result.select("kind", "rows_extracted", "rows_unique", "duplicates_dropped", "rows_valid", "success")


@query
def run_posting_session_capped(spark, sf_dir):
    result = run.run_posting_session(
        st.posting_pages(spark, sf_dir), st.posting_detail_pages(spark, sf_dir),
        st.SEGMENTS, st.POSTING_HOST, staging.shared_folder(spark), st.AS_OF, fv.ROWS_PER_TERM, stamp="20240201_120000",
        limit=fv.ENRICHED_POSTINGS,
    )
    return result.select("kind", "rows_extracted", "rows_unique", "duplicates_dropped", "rows_valid", "success")


SESSION_COUNTS = (
    "kind", "pages", "pages_blocked", "pages_thin", "rows_other_terms", "rows_extracted", "rows_unique", "rows_valid", "success", "error",
)


def _with_web_pages(pages, spark, sf_dir):
    """Result pages, and among them web pages of another site, some of them blocked or nearly empty."""
    web = _pages(spark, sf_dir).select((-F.col("page_id") - 1).alias("page_id"), "url", "html", F.lit("web").alias("term"))
    return pages.select("page_id", "url", "html", "term").unionByName(web.select(*[F.col(n).cast(pages.schema[n].dataType) for n in ("page_id", "url", "html", "term")]))


def _session_counts(result):
    entries = F.array_sort(F.map_entries("category_counts"))
    said = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return result.select(*SESSION_COUNTS, said.alias("categories"))


@query
def run_listing_session_counts(spark, sf_dir):
    pages = _with_web_pages(st.listing_pages(spark, sf_dir), spark, sf_dir)
    return _session_counts(run.run_listing_session(
        pages, None, st.LISTING_TERMS, st.LISTING_HOST, staging.shared_folder(spark), st.AS_OF, stamp="20240201_120000", fmt="parquet",
    ))


@query
def run_posting_session_counts(spark, sf_dir):
    pages = _with_web_pages(st.posting_pages(spark, sf_dir), spark, sf_dir)
    return _session_counts(run.run_posting_session(
        pages, None, st.SEGMENTS, st.POSTING_HOST, staging.shared_folder(spark), st.AS_OF, stamp="20240201_120000", fmt="parquet",
    ))


@query
def run_session_failed(spark, sf_dir):
    """A session whose snapshot exists already: a row with the error instead of an exception."""
    folder = staging.shared_folder(spark)
    pages = st.posting_pages(spark, sf_dir)
    runs = [run.run_posting_session(pages, None, st.SEGMENTS, st.POSTING_HOST, folder, st.AS_OF, stamp="1") for _ in range(2)]
    failed = F.col("error").contains("already exists")
    return runs[0].unionByName(runs[1]).select("kind", "pages", "rows_extracted", "rows_valid", "success", failed.alias("exists_already"))


# --- dedup, caps, order, union -------------------------------------------------------------------------------------------


@query
def dedup_listings(spark, sf_dir):
    return ingest.dedup_listings(st.raw_listings(spark, sf_dir), st.LISTING_ORDER)


@query
def dedup_listings_canonical(spark, sf_dir):
    return ingest.dedup_listings(st.raw_listings(spark, sf_dir), st.LISTING_ORDER, canonical=True)


@query
def dedup_postings(spark, sf_dir):
    return ingest.dedup_postings(_numbered(spark, sf_dir), st.POSTING_ORDER)


def _in_snapshots(rows, order, dedup, spark):
    """Three snapshots one after the other, against an index that starts empty."""
    index = f"{staging.shared_folder(spark)}/index"
    number = F.pmod(F.col(order), F.lit(3))
    return reduce(DataFrame.unionByName, [dedup(rows.where(number == k), index) for k in range(3)])


@query
def dedup_listings_incremental(spark, sf_dir):
    return _in_snapshots(st.raw_listings(spark, sf_dir), SNAPSHOT_BY, lambda rows, index: ingest.dedup_listings_incremental(rows, index, st.LISTING_ORDER), spark)


@query
def dedup_postings_incremental(spark, sf_dir):
    return _in_snapshots(_numbered(spark, sf_dir), "pos", lambda rows, index: ingest.dedup_postings_incremental(rows, index, st.POSTING_ORDER), spark)


@query
def cap_per_term(spark, sf_dir):
    return ingest.cap_per_term(st.raw_listings(spark, sf_dir), "categoria", st.LISTING_ORDER, fv.ROWS_PER_TERM)


@query
def cap_per_term_large(spark, sf_dir):
    return ingest.cap_per_term(st.raw_listings(spark, sf_dir), "categoria", st.LISTING_ORDER, n=5000)


@query
def rank_sort(spark, sf_dir):
    return reports.report_vendor_placed(_listings(spark, sf_dir)).select("place", "vendedor_limpio", "reputacion_limpia", "cantidad_productos")


@query
def union_terms(spark, sf_dir):
    rows = st.raw_postings(spark, sf_dir)
    return ingest.union_terms({term: rows.where(F.col("term") == term) for term in st.POSTING_TERMS})


@query
def number_terms(spark, sf_dir):
    return _numbered(spark, sf_dir)


# The names of the operators, where a function of the library already has the plain name here.
for _name in ("parse_price_", "parse_posted_at_", "price_band_", "age_band_"):
    QUERIES[_name.rstrip("_")] = QUERIES.pop(_name)
