"""Places, boundaries of large groups and medians by counting, against sorted lists."""

import math
import random
import struct

import pytest
from pyspark.sql import Window as W, functions as F

from vitrina.functions import images
from vitrina.operators import ingest, ranks
from vitrina.plans import reports, run


def test_images_of_doubles_sort_like_doubles(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, math.inf, math.nan, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308]
    values += [x for e in range(-1073, 1023) for x in (2.0**e, math.nextafter(2.0**e, 0), math.nextafter(2.0**e, math.inf))]
    values += [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(5000)]
    values += [-v for v in values]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for row in frame.select("v", images.double_image(F.col("v")).alias("i")).collect():
        if math.isnan(row.v):
            assert row.i == images.INFINITE + 1 and math.isnan(images.from_image(row.i))
            continue
        bits = struct.unpack("q", struct.pack("d", abs(row.v)))[0]
        assert row.i == (-bits if row.v < 0 else bits) and images.from_image(row.i) == row.v
    assert spark.range(1).select(images.double_image(F.lit(None).cast("double")).alias("i")).first().i is None


def middle(values):
    known = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    return (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2 if known else None


def test_median(spark):
    rng = random.Random(2)
    cases = [
        [], [None], [1.0], [2.0, 1.0], [3.5] * 9, [math.nan] * 3 + [1.0], [math.nan] * 3 + [1.0, 2.0, 0.5], [-math.inf, math.inf, 1.0],
        [rng.random() for _ in range(2001)], [1.0 + k * 2.0**-52 for k in range(1000)], [rng.gauss(0, 1e9) for _ in range(1500)], [-1.5, 2.5, -0.0, None],
    ]
    for values in cases:
        got = reports.exact_median(spark.createDataFrame([(v,) for v in values], "x double").repartition(3), "x").first().median
        want = middle(values)
        assert got == want or (want is not None and math.isnan(want) and math.isnan(got)), (values[:5], got, want)


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(3)
    rows = [
        (rng.choice(["hot", "hot", "hot", "b", None, "c"]), rng.choice([None, 1, 2, 3]), rng.randint(-10**12, 10**12), rng.choice(["x" * 30, "y", "", None]),
         rng.gauss(0, 5), k)
        for k in range(4000)
    ]
    return spark.createDataFrame(rows, "k string, a int, b long, s string, d double, id long")


@pytest.mark.parametrize("order", [["b", "id"], ["a", "d", "id"], ["d"], ["s", "id"]])
@pytest.mark.parametrize("n", [15, 900])
def test_cut_keeps_the_first_rows_and_little_else(mixed, order, n):
    kept = ranks.cut_to_first(mixed, ["k"], order, n, spare=10)
    number = F.row_number().over(W.partitionBy("k").orderBy(*order, "id"))

    def first(frame):
        return sorted(r.id for r in frame.withColumn("r", number).where(F.col("r") <= n).collect())

    assert kept.columns == mixed.columns and first(kept) == first(mixed)
    if order[0] != "s":  # long texts may tie
        assert max(r["count"] for r in kept.groupBy("k").count().collect()) <= n + 10 + 4 * (order[0] == "a")


def test_large_caps(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "one").otherwise("hot").alias("term"), (F.col("id") * 7919 % 30_000).alias("pos"))
    got = {r.term: r for r in ingest.cap_per_term(rows, "term", ("pos",), 5000).groupBy("term").agg(F.count("*").alias("n"), F.max("pos").alias("last")).collect()}
    want = {r.term: sorted(x.pos for x in rows.where(F.col("term") == r.term).collect())[4999] for r in rows.select("term").distinct().collect()}
    assert {t: (r.n, r.last) for t, r in got.items()} == {t: (5000, last) for t, last in want.items()}
    assert ingest.cap_per_term(rows.withColumn("term", F.lit("all")), "term", ("pos",), 29_999).count() == 29_999
    with pytest.raises(TypeError):
        ingest.first_rows(rows, ["term"], [F.col("pos").desc()], 5000)


def test_places(spark, mixed):
    rows = mixed.select("a", "s").unionByName(spark.createDataFrame([(9, "same")] * 500, "a int, s string"))
    placed = sorted(ranks.with_place(rows, [F.desc("a"), F.asc("s")]).collect(), key=lambda r: r.place)
    assert [r.place for r in placed] == list(range(4500))
    keys = [(-(r.a if r.a is not None else -1), r.s is not None, r.s or "") for r in placed]
    assert keys == sorted(keys)
    assert ranks.with_place(rows.limit(0), ["a"]).collect() == []


def test_groups_of_one_pass_equal_the_reports(spark):
    from checks import sample_tables as st
    from vitrina.plans import clean

    sf = "/root/testdata/sf0.001"
    listings, postings = clean.clean_listings(st.raw_listings(spark, sf)), clean.clean_postings(st.raw_postings(spark, sf), st.AS_OF)
    listed, posted = reports.listing_groups(listings), reports.posting_groups(postings)
    for one, other in (
        (reports.report_price_band(listings), reports.price_band_of(listed)), (reports.report_vendor(listings), reports.vendor_of(listed)),
        (reports.report_posting_age(postings), reports.posting_age_of(posted)), (reports.report_experience(postings), reports.experience_of(posted)),
        (reports.report_modality_location(postings), reports.modality_location_of(posted)),
        (reports.summary(listings, postings, st.AS_OF), reports.summary_of(listed, posted, listings, st.AS_OF)),
    ):
        assert one.dtypes == other.dtypes and one.collect() == other.collect()
    for groups in (listed, posted):
        text = groups._jdf.queryExecution().executedPlan().toString()
        assert text.count("Scan parquet") == (3 if groups is listed else 1)  # listings are derived from three tables
        assert "Expand" in text
    nothing = reports.summary_of(reports.listing_groups(listings.limit(0)), reports.posting_groups(postings.limit(0)), listings.limit(0), st.AS_OF).first()
    assert nothing.total_productos_ml == 0 and nothing.precio_mediano_ml is None and nothing.empleos_remotos == 0


def test_own_reports(spark):
    from checks import sample_tables as st

    sf = "/root/testdata/sf0.001"
    prepared = run.run_all(st.raw_listings(spark, sf), st.raw_postings(spark, sf), st.AS_OF, more={
        "por_vendedor": lambda listings, postings: listings.groupBy("vendedor").count(), "avisos": lambda listings, postings: postings.groupBy("term").count(),
    })
    assert len(prepared) == 9 and sum(r["count"] for r in prepared["por_vendedor"].collect()) == 6000 and prepared["avisos"].count() > 0
    with pytest.raises(ValueError, match="reporte_resumen"):
        run.run_all(st.raw_listings(spark, sf), st.raw_postings(spark, sf), st.AS_OF, more={"reporte_resumen": lambda a, b: a})
