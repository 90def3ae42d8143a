"""Shipped reports recomputed from the 80 ranked listings; expected values of the other reports from the same rows."""

from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from vitrina.functions.prices import price_band
from vitrina.functions.score import value_score
from vitrina.plans import reports

GOLDEN = Path(__file__).parent / "golden"
RANKING = ("producto string, precio_numerico double, reputacion_limpia string, disponible_bool boolean, envio_gratis_bool boolean, "
           "puntaje_valor double, categoria string, vendedor_limpio string")
VENDORS = ("vendedor_limpio string, reputacion_limpia string, cantidad_productos bigint, precio_promedio double, "
           "productos_disponibles bigint, productos_envio_gratis bigint")


def read(spark, name, schema):
    return spark.read.schema(schema).csv(str(GOLDEN / name), header=True, quote='"', escape='"')


def ranked(spark):
    rows = read(spark, "ranking.csv", RANKING).withColumnRenamed("puntaje_valor", "wanted")
    score = value_score(*[F.col(n) for n in ("reputacion_limpia", "disponible_bool", "envio_gratis_bool", "precio_numerico")])
    return rows.withColumns({"puntaje_valor": score, "rango_precio": price_band(F.col("precio_numerico"))})


def test_scores(spark):
    rows = ranked(spark)
    assert rows.count() == 80
    assert rows.where("wanted = puntaje_valor").count() == 80


def test_vendor_report(spark):
    want = Counter(map(tuple, read(spark, "vendors.csv", VENDORS).collect()))
    assert Counter(map(tuple, reports.report_vendor(ranked(spark)).collect())) == want and len(want) == 25


def test_ranking_report(spark):
    want = [tuple(r) for r in read(spark, "ranking.csv", RANKING).collect()]
    got = [tuple(r) for r in reports.report_value_ranking(ranked(spark)).collect()]
    assert Counter(got) == Counter(want)
    assert [r[5] for r in got] == [r[5] for r in want]  # same order up to ties


def test_bands_and_summary(spark):
    rows = ranked(spark)
    assert [tuple(r) for r in reports.report_price_band(rows).collect()] == [
        ("Alto", 47, 1042974.13, 509999.0, 2169999.0), ("Medio", 33, 334142.24, 178980.0, 499999.0)]
    modes = spark.createDataFrame([("Remoto",)] * 3 + [("Híbrido",)] + [("No Encontrado",)], "modalidad_limpia string")
    assert tuple(reports.summary(rows, modes, "2025-06-07 10:00:00").first()) == (
        "2025-06-07 10:00:00", 80, 5, 750580.98, 615999.0, 80, 67, 3, 0, 1)


def test_posting_reports_are_sorted_like_ours(spark):
    ages = read(spark, "posting_age.csv", "categoria_fecha string, cantidad_empleos bigint, empresas_unicas bigint")
    assert ages.collect() == ages.orderBy("categoria_fecha").collect()
    places = read(spark, "modality_location.csv", "modalidad_limpia string, ubicacion string, cantidad_empleos bigint, empresas_unicas bigint")
    counts = [r.cantidad_empleos for r in places.collect()]
    assert counts == sorted(counts, reverse=True) and sum(counts) == 39
