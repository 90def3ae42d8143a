"""Hot keys: a third of all rows shares one url, term or key; the work must be split, the result stay whole."""

import pytest
from pyspark.sql import functions as F

from vitrina.operators import enrich, ingest
from vitrina.plans import reports

N = 60_000


@pytest.fixture
def skewed(spark):
    """Session settings that make small data count as skewed, as large data would with the defaults."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value)


def hot(spark):
    number = F.col("id")
    url = F.when(number % 3 == 0, "http://hot").when(number % 3 == 1, F.concat(F.lit("http://x/"), (number % 5000).cast("string"))).otherwise("N/A")
    return spark.range(0, N, 1, 16).select(
        F.lit(0).alias("term_no"), number.alias("pos"), F.when(number % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), number % 50)).alias("categoria"),
        F.concat(F.lit("p"), number % 7).alias("producto"), F.lit("$1").alias("precio"), F.lit("v").alias("vendedor"), url.alias("url_producto"),
        F.lit("").alias("ubicacion"), F.lit("").alias("reputacion_vendedor"),
    )


def details(spark):
    urls = F.when(F.col("id") == 0, "http://hot").otherwise(F.concat(F.lit("http://x/"), F.col("id").cast("string")))
    return spark.range(5000).select(urls.alias("url"), F.lit(1).alias("fetched_at"), F.lit("lugar").alias("ubicacion"), F.lit("verde").alias("reputacion_vendedor"))


def final_plan(frame):
    frame.write.format("noop").mode("overwrite").save()
    rows = frame.collect()
    return rows, frame._jdf.queryExecution().executedPlan().toString()


def test_hot_url_is_split_in_the_join(skewed):
    rows, plan = final_plan(enrich.enrich_listings(hot(skewed), details(skewed), per_term=None))
    assert len(rows) == N and "SortMergeJoin(skew=true)" in plan
    known = sum(r.ubicacion == "lugar" for r in rows)
    assert known == sum(1 for i in range(N) if i % 3 == 0 or (i % 3 == 1 and i % 5000 != 0))


def test_hot_term_and_key(skewed):
    frame = hot(skewed)
    rows, plan = final_plan(ingest.cap_per_term(frame, "categoria", ("pos",), 8))
    assert len(rows) == 8 * 51 and "WindowGroupLimit" in plan
    unique, plan = final_plan(ingest.dedup_listings(frame))
    assert len({(r.url_producto, r.producto if r.url_producto == "N/A" else "") for r in unique}) == len(unique)
    assert sum(r.url_producto == "http://hot" for r in unique) == 1 and "WindowGroupLimit" in plan
    rows, _ = final_plan(enrich.enrich_listings(frame, details(skewed), per_term=8))
    assert len(rows) == N and sum(r.ubicacion == "lugar" for r in rows if r.categoria == "hot") == 8


def test_hot_value_in_the_median(spark):
    values = spark.range(0, N, 1, 16).select(F.when(F.col("id") % 3 == 0, 500.0).otherwise(F.col("id").cast("double")).alias("x"))
    assert reports.exact_median(values, "x").first().median == values.agg(F.median("x")).first()[0]
