"""Rows on their way to the details: their texts travel as one and arrive as they were."""

import pytest
from pyspark.sql import functions as F

from vitrina.operators import enrich

TEXTS = ["", None, "a", "\x1e", "\x1f", "\x1e0", "\x1e1", "\x1e2", "\x1e\x1f2\x1f", "N/A", "ñ ", "\x1f\x1f", "0"]
COLUMNS = "term_no int, pos bigint, categoria string, url_producto string, ubicacion string, reputacion_vendedor string, precio double, nota string, marcas array<string>"


@pytest.fixture
def shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_every_text_arrives_as_it_was(shuffled):
    urls = ["http://a", "N/A", None, "http://b", ""]
    rows = [(1, k * 13 + n, TEXTS[k], urls[(k + n) % 5], TEXTS[n], TEXTS[(k + n) % 13], float(n), TEXTS[-n], [TEXTS[k], None]) for k in range(13) for n in range(13)]
    frame = shuffled.createDataFrame(rows + rows, COLUMNS)
    raw = frame.withColumn("nota", F.when(F.col("pos") % 7 == 0, F.expr("CAST(X'FF1EC31F' AS STRING)")).otherwise(F.col("nota")))
    details = shuffled.createDataFrame([("http://a", 1, "lugar", "Desconocida"), ("N/A", 1, "no", "no"), ("", 1, "no", "no")], "url string, fetched_at int, ubicacion string, reputacion_vendedor string")
    found = enrich.enrich_listings(raw, details, per_term=None)
    assert found.dtypes == raw.dtypes
    expected = raw.withColumn("ubicacion", F.when(F.col("url_producto") == "http://a", "lugar").otherwise(F.col("ubicacion")))

    def seen(rows):
        return sorted(map(str, rows.withColumn("nota", F.hex("nota")).collect()))

    assert seen(found) == seen(expected)


def test_a_row_is_shuffled_with_its_texts_as_one(shuffled):
    frame = shuffled.createDataFrame([(1, 1, "a", "http://a", "b", "c", 1.0, "d", [])], COLUMNS)
    details = shuffled.createDataFrame([("http://a", 1, "x", "y")], "url string, fetched_at int, ubicacion string, reputacion_vendedor string")
    plan = enrich.enrich_listings(frame, details, per_term=None)._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    names = [plan.children().head().output().apply(k).name() for k in range(plan.children().head().output().size())]
    assert sorted(names) == ["__texts", "marcas", "pos", "precio", "term_no", "url_producto"]
