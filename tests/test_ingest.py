"""Dedup, caps, union and enrichment: exact results, whatever the input order, partitioning or skew."""

import random

import pytest
from pyspark.sql import functions as F

from vitrina import fixed_values as fv
from vitrina.operators import enrich, ingest
from vitrina.plans import clean, reports, run
from vitrina.schemas import LISTING_SCHEMA, POSTING_SCHEMA

COLUMNS = "term_no int, pos int, categoria string, producto string, precio string, vendedor string, url_producto string, ubicacion string, reputacion_vendedor string"


def listing_data(n=900, seed=1):
    rng = random.Random(seed)
    rows = []
    for pos in range(n):
        term = 0 if rng.random() < 0.4 else rng.randrange(1, 4)
        url = "N/A" if rng.random() < 0.4 else f"http://x/{rng.randrange(40)}?{rng.randrange(3)}"
        rows.append((term, pos, f"t{term}", f"p{rng.randrange(4)}", f"${rng.randrange(3)}", rng.choice(["v", "N/A"]), url, "", ""))
    return rows


def keep_first(rows, canonical=False):
    seen, kept = set(), []
    for row in sorted(rows, key=lambda r: (r[0], r[1])):
        url = row[6].split("?")[0].split("#")[0] if canonical and row[6] != "N/A" else row[6]
        key = url if row[6] != "N/A" else f"{row[3]}_{row[4]}_{row[5]}"
        if key not in seen:
            seen.add(key)
            kept.append(row)
    return kept


@pytest.mark.parametrize("partitions", [1, 4, 200])
@pytest.mark.parametrize("canonical", [False, True])
def test_dedup_listings(spark, partitions, canonical):
    rows = listing_data()
    shuffled = random.Random(partitions).sample(rows, len(rows))
    frame = spark.createDataFrame(shuffled, COLUMNS).repartition(partitions)
    got = [tuple(r) for r in ingest.dedup_listings(frame, canonical=canonical).collect()]
    assert sorted(got) == sorted(keep_first(rows, canonical))


def test_dedup_postings(spark):
    rows = [(0, 1, "No encontrado", "a", "b"), (0, 2, "http://x", "a", "b"), (1, 1, "No encontrado", "a", "b"), (1, 2, "http://x", "c", "d"),
            (1, 3, "No encontrado", "a", "c"), (1, 4, "http://x?y", "a", "b"), (2, 1, "", "a", "b"), (2, 2, "", "z", "z")]
    frame = spark.createDataFrame(rows, "term_no int, pos int, url_empleo string, titulo_puesto string, empresa string")
    assert sorted((r.term_no, r.pos) for r in ingest.dedup_postings(frame).collect()) == [(0, 1), (0, 2), (1, 3), (1, 4), (2, 1)]
    assert sorted((r.term_no, r.pos) for r in ingest.dedup_postings(frame, canonical=True).collect()) == [(0, 1), (0, 2), (1, 3), (2, 1)]


@pytest.mark.parametrize("n", [1, 20, 1500])
def test_cap_per_term(spark, n):
    rows = [(f"t{i % 3 if i % 5 else 0}", i) for i in range(9000)]
    want = []
    for term in ("t0", "t1", "t2"):
        want += sorted((r for r in rows if r[0] == term), key=lambda r: r[1])[:n]
    frame = spark.createDataFrame(random.Random(n).sample(rows, len(rows)), "term string, pos int")
    assert sorted(map(tuple, ingest.cap_per_term(frame, "term", ("pos",), n).collect())) == sorted(want)


def test_union_and_numbering_agree(spark):
    rows = spark.createDataFrame([(f"t{i % 4}", i) for i in range(40)], "term string, pos int")
    terms = ["t2", "t0", "t1"]
    united = ingest.union_terms({t: rows.where(F.col("term") == t) for t in terms})
    numbered = ingest.number_terms(rows, "term", terms)
    assert sorted(map(tuple, united.collect())) == sorted(map(tuple, numbered.collect()))
    assert {r.term: r.term_no for r in numbered.collect()} == {"t2": 0, "t0": 1, "t1": 2}


def enriched(rows, details, per_term):
    latest = {}
    for url, fetched, place, reputation in details:
        if url not in latest or (-fetched, place, reputation) < latest[url]:
            latest[url] = (-fetched, place, reputation)
    out, seen = [], {}
    for row in sorted(rows, key=lambda r: (r[2], r[1])):
        seen[row[2]] = seen.get(row[2], 0) + 1
        row = list(row)
        if (per_term is None or seen[row[2]] <= per_term) and row[6].startswith("http") and row[6] in latest:
            _, place, reputation = latest[row[6]]
            if place != "Desconocida":
                row[7] = place
            if reputation != "Desconocida":
                row[8] = reputation
        out.append(tuple(row))
    return out


@pytest.mark.parametrize("per_term", [8, 1, None])
def test_enrich_listings(spark, per_term):
    rows = listing_data()
    rng = random.Random(3)
    details = [(f"http://x/{rng.randrange(60)}?{rng.randrange(3)}", rng.randrange(5), rng.choice(["Desconocida", "A", "B"]), rng.choice(["Desconocida", "verde"]))
               for _ in range(400)]
    frame = spark.createDataFrame(rows, COLUMNS)
    looked_up = spark.createDataFrame(details, "url string, fetched_at int, ubicacion string, reputacion_vendedor string")
    got = enrich.enrich_listings(frame, looked_up, per_term=per_term)
    assert got.columns == frame.columns
    assert sorted(map(tuple, got.collect())) == sorted(enriched(rows, details, per_term))


def test_enrich_postings(spark):
    rows = [(0, i, f"http://x/{i % 30}" if i % 4 else "No encontrado", "corto", "No disponible", "No disponible") for i in range(60)]
    postings = spark.createDataFrame(rows, "term_no int, pos int, url_empleo string, descripcion_breve string, nivel_experiencia string, beneficios_ofrecidos string")
    details = spark.createDataFrame(
        [(f"http://x/{i}", when, " " + "d" * 300 if i % 2 else "No disponible", "Senior" if i % 3 else "No disponible", f"b{when}")
         for i in range(30) for when in (1, 2)],
        "url string, fetched_at int, descripcion_completa string, nivel_experiencia string, beneficios_ofrecidos string")
    got = {r.pos: r for r in enrich.enrich_postings(postings, details, limit=20).collect()}
    assert len(got) == 60
    for pos, row in got.items():
        hit = pos < 20 and pos % 4
        assert row.beneficios_ofrecidos == ("b2" if hit else "No disponible")
        assert row.descripcion_breve == ("d" * 200 + "..." if hit and pos % 2 else "corto")
        assert row.nivel_experiencia == ("Senior" if hit and pos % 3 else "No disponible")
    everything = enrich.enrich_postings(postings, details, limit=None)
    assert everything.where("beneficios_ofrecidos = 'b2'").count() == 45


@pytest.mark.parametrize("values", [
    [1.0], [1.0, 2.0], [3.0, 1.0, 2.0], [0.0] * 5, [-5.0, 0.0, 5.0, 5.0], [-2.0, -1.0], [1e-9, 1e9, 1e15, -1e12], [2.0, 2.0, 1e6, 1e6],
    [float(i * 7919 % 1000) for i in range(1000)], [5.0] * 400 + [float(i) for i in range(300)], [],
])
def test_median(spark, values):
    import statistics

    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    want = statistics.median(values) if values else None
    assert reports.exact_median(frame, "x").first().median == want


def test_empty_and_all_null(spark):
    for rows in ([], [(None,) * 10] * 3):
        listings = clean.clean_listings(spark.createDataFrame(rows, LISTING_SCHEMA))
        postings = clean.clean_postings(spark.createDataFrame([(None,) * 11] * len(rows), POSTING_SCHEMA), "2024-02-01 12:00:00")
        frames = run.all_reports(listings, postings, "2024-02-01 12:00:00")
        sizes = {name: frame.count() for name, frame in frames.items()}
        assert sizes["reporte_resumen"] == 1 and sizes["empleo_por_factor_personalizado_modalidad_ubicacion"] == 0
        one = frames["reporte_resumen"].first()
        assert (one.total_productos_ml, one.total_empleos_linkedin) == (len(rows), len(rows))
        assert (one.productos_disponibles, one.precio_mediano_ml) == (0, 0.0 if rows else None)
        vendors = frames["productos_por_vendedor"].collect()
        assert [(r.vendedor_limpio, r.cantidad_productos) for r in vendors] == ([(fv.NO_VENDOR, 0)] if rows else [])


def test_documented_reports(spark):
    listings = spark.createDataFrame([("a", "$1.000"), ("a", "$3.000"), ("", "N/A"), ("b", "$5,5")], "categoria string, precio string")
    counts = {r.categoria: (r.cantidad_productos, r.categorias) for r in reports.category_counts(listings).collect()}
    assert counts == {"a": (2, 3), "b": (1, 3), fv.NO_CATEGORY: (1, 3)}
    assert reports.average_price_simple(listings).first().precio_promedio == 2000.0
    priced = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 9.0), ("b", 5.0)], "categoria string, precio_numerico double")
    stats = [tuple(r) for r in reports.category_price_stats(priced).collect()]
    assert stats == [("a", 2.0, 2, pytest.approx(2 ** 0.5)), ("b", 5.0, 1, None)]


def test_rows_that_share_a_key_are_not_multiplied(spark):
    rows = spark.createDataFrame([("a", 1, "http://x/1"), ("a", 1, "http://x/1"), ("a", 1, "http://x/2")], "categoria string, pos int, url_producto string")
    rows = rows.selectExpr("*", "'-' AS ubicacion", "'-' AS reputacion_vendedor")
    details = spark.createDataFrame([(f"http://x/{k}", f"2024-01-0{k}", f"place {k}", "r") for k in (1, 2)], "url string, fetched_at string, ubicacion string, reputacion_vendedor string")
    for per_term in (8, None):
        got = enrich.enrich_listings(rows, details, per_term=per_term).collect()
        assert sorted((r.url_producto, r.ubicacion) for r in got) == [("http://x/1", "place 1")] * 2 + [("http://x/2", "place 2")]


def test_median_with_nan_and_infinity(spark):
    for values in ([1.0, 2.0, 3.0, 4.0, float("nan")], [float("-inf"), -2.0, 5.0, float("inf"), float("nan")], [float("nan")] * 2 + [1.0]):
        frame = spark.createDataFrame([(v,) for v in values], "v double")
        want = frame.agg(F.median("v")).first()[0]
        got = reports.exact_median(frame, "v").first().median
        assert got == want or (got != got and want != want)
