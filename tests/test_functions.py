"""Normalisers: every branch in tables, and generated texts against small Python functions written from the rules."""

import math
import re
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vitrina import fixed_values as fv
from vitrina.functions import labels, text
from vitrina.functions.dates import age_band, as_of_column, parse_posted_at
from vitrina.functions.numbers import round_exact, round_frame
from vitrina.functions.prices import PRICE_BANDS_SIX, parse_price, price_band
from vitrina.functions.score import Weights, value_score

AS_OF = "2024-02-01 12:00:00"
NOW = datetime(2024, 2, 1, 12)


def apply(spark, column, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [row.y for row in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def check(spark, column, table, kind="string"):
    got = apply(spark, column, [given for given, _ in table], kind)
    assert list(zip([g for g, _ in table], got)) == table


def test_price(spark):
    check(spark, parse_price, [
        (None, 0.0), ("No disponible", 0.0), ("NaN", 0.0), ("Precio no disponible", 0.0), ("$1.234.567,89", 1234567.89),
        ("$ 250.000", 250000.0), ("$1,234.56", 1.23456), ("1,234,567", 0.0), ("178980.5", 1789805.0), ("12d", 0.0),
        ("1e5", 100000.0), ("-5", -5.0), ("+5", 5.0), (",5", 0.5), ("5,", 5.0), ("", 0.0), ("$", 0.0), ("e5", 0.0), ("inf", 0.0),
        ("\xa012", 12.0), ("0x1p3", 0.0),
    ])


def test_vendor_and_flags(spark):
    check(spark, text.clean_vendor, [
        (None, fv.NO_VENDOR), ("NO DISPONIBLE", fv.NO_VENDOR), ("Por ACME", "Por ACME"), (" no disponible", " no disponible"),
    ])
    check(spark, text.is_available, [
        (None, False), ("SÍ", True), ("si", True), ("True", True), ("1", True), ("disponible", True), (" Sí", False),
        ("1.0", False), ("gratis", False),
    ])
    check(spark, text.has_free_shipping, [("Gratis", True), ("disponible", False), ("No", False)])


def test_reputation(spark):
    check(spark, labels.classify_reputation, [
        (None, fv.REPUTATION_NONE), ("No disponible", fv.REPUTATION_NONE), ("MercadoX Verde", fv.REPUTATION_GOOD),
        ("muy buena y mala", fv.REPUTATION_GOOD), ("Excelente", fv.REPUTATION_GOOD), ("amarilla", fv.REPUTATION_REGULAR),
        ("Irregular", fv.REPUTATION_REGULAR), ("roja", fv.REPUTATION_BAD), ("Malaga", fv.REPUTATION_BAD),
        ("Málaga", fv.REPUTATION_NONE), ("nuevo", fv.REPUTATION_NEW), ("SIN REPUTACIÓN", fv.REPUTATION_NEW),
        ("Platino", fv.REPUTATION_NONE),
    ])


def test_experience(spark):
    check(spark, labels.classify_experience, [
        (None, fv.NOT_SPECIFIED), ("nan", fv.NOT_SPECIFIED), ("no disponible", fv.NOT_SPECIFIED),
        ("Senior developer", fv.LEVEL_SENIOR), ("Developer Sr", fv.LEVEL_SENIOR), ("developer jr", fv.LEVEL_ENTRY),
        ("Desenvolvedor", fv.LEVEL_MID), ("Entry level", fv.LEVEL_ENTRY), ("trainee", fv.LEVEL_ENTRY), ("Sr", fv.LEVEL_SENIOR),
        ("Mid-Senior level", fv.LEVEL_SENIOR), ("semi", fv.LEVEL_MID), ("pleno", fv.LEVEL_MID), ("jr", fv.NOT_SPECIFIED),
        ("Director", fv.NOT_SPECIFIED),
    ])


def test_modality(spark):
    check(spark, labels.classify_modality, [
        (None, fv.NOT_SPECIFIED), ("no disponible", fv.NOT_SPECIFIED), ("En remoto / presencial", "Remoto"), ("On-Site", "Presencial"),
        ("oficina", "Presencial"), ("HYBRID", "Híbrido"), ("No encontrado", "No Encontrado"), ("no-aplica", "No-Aplica"),
        ("o'neil 3a época", "O'Neil 3A Época"),
    ])


def _posted(value):
    default = NOW - timedelta(hours=12)
    if value is None or value.lower() in ("no encontrado", "nan"):
        return default
    try:
        return datetime.strptime(value, "%Y-%m-%d")
    except ValueError:
        pass
    low = value.lower()
    digits = re.search("[0-9]+", low)
    for words, hours in fv.DATE_UNITS:
        if any(word in low for word in words):
            return NOW - timedelta(hours=hours * int(digits.group())) if digits else default
    return default


POSTED = [
    None, "No encontrado", "nan", "", "  ", "2024-01-31", "2024-1-5", "2024-01- 5", "2024-02-30", "2024-13-01", "0000-01-01",
    "2024-01-05T10:00:00", "2024-01-05 ", "Hace 5 horas", "3 hours ago", "hace horas", "ahora", "Hace 2 días", "8 DAYS", "hoy",
    "Hace 2 semanas", "2 semanas", "una semana", "1 mes", "Hace 3 meses", "2 months", "Hace 5 minutos", "10/12", "Publicado",
]


def test_posted_at(spark):
    moment = as_of_column(AS_OF)
    got = apply(spark, lambda x: parse_posted_at(x, moment), POSTED)
    assert got == [_posted(value) for value in POSTED]
    strict = apply(spark, lambda x: parse_posted_at(x, moment, True), ["Hace 2 semanas", "Hace 3 meses", "Hace 2 días"])
    assert strict == [NOW - timedelta(days=days) for days in (14, 90, 2)]
    far = apply(spark, lambda x: parse_posted_at(x, moment), ["99999999999 días", "123456789012345678901234 horas", "20000000 h hora"])
    assert far == [NOW - timedelta(hours=12)] * 3
    # As far as the calendar goes.
    hours = (NOW - datetime(1, 1, 1)) // timedelta(hours=1)
    near = apply(spark, lambda x: parse_posted_at(x, moment), [f"{hours} horas", f"{hours + 1} horas"])
    assert near == [NOW - timedelta(hours=hours), NOW - timedelta(hours=12)]


def test_age_band(spark):
    def band(moment):
        days = (NOW - moment).days
        return fv.AGE_FIRST if days == 0 else fv.AGE_WEEK if days <= 7 else fv.AGE_OLDER

    moments = [NOW - timedelta(**delta) for delta in (
        {"hours": 0}, {"hours": 12}, {"hours": 23, "minutes": 59}, {"days": 1}, {"days": 7, "hours": 23}, {"days": 8}, {"days": 400},
        {"seconds": -1}, {"days": -30},
    )]
    moment = as_of_column(AS_OF)
    assert apply(spark, lambda x: age_band(x, moment), moments, "timestamp_ntz") == [band(m) for m in moments]


def test_price_bands(spark):
    check(spark, price_band, [(-1.0, "Bajo"), (99999.99, "Bajo"), (100000.0, "Medio"), (500000.0, "Medio"), (500000.01, "Alto")], "double")
    check(spark, lambda x: price_band(x, PRICE_BANDS_SIX), [
        (49999.9, "Muy Bajo"), (50000.0, "Bajo"), (100000.0, "Medio-Bajo"), (300000.0, "Medio-Bajo"), (300000.5, "Medio"),
        (500000.0, "Medio"), (1000000.0, "Alto"), (1000000.5, "Premium"),
    ], "double")


def _score(reputation, available, free, price):
    points = {fv.REPUTATION_GOOD: 4, fv.REPUTATION_REGULAR: 2, fv.REPUTATION_NEW: 1}.get(reputation, 0)
    points += 2 * available + free
    if price > 0:
        if price < 100000:
            points += max(0, 3 - price / 50000)
        elif price <= 500000:
            points += max(0, 2 - (price - 100000) / 200000)
        else:
            points += max(0, 1 - (price - 500000) / 500000)
    return float(round(points, 2))


def test_score(spark):
    prices = [0.0, -5.0, 0.01, 50000.0, 50250.0, 99750.0, 99999.99, 100000.0, 101000.0, 103000.0, 499999.0, 500000.0, 500001.0, 502500.0,
              999999.0, 1000000.0, 5e6] + [250.0 * k for k in range(1, 4000, 7)]
    names = [label for label, _ in Weights().reputation] + ["otra", None]
    cases = [(names[i % 7], i % 2 == 0, i % 3 == 0, price) for i, price in enumerate(prices)]
    rows = spark.createDataFrame([(i, *case) for i, case in enumerate(cases)], "i int, r string, a boolean, f boolean, p double")
    got = rows.select("i", value_score(F.col("r"), F.col("a"), F.col("f"), F.col("p")).alias("s")).orderBy("i").collect()
    assert [row.s for row in got] == [_score(*case) for case in cases]
    heavier = rows.select(value_score(F.col("r"), F.col("a"), F.col("f"), F.col("p"), Weights(free_shipping=3.0)).alias("s"), "f", "i")
    for row, case in zip(heavier.orderBy("i").collect(), cases):
        assert row.s == pytest.approx(_score(*case) + (2 if case[2] else 0), abs=0.011)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(
    st.floats(0, 20, allow_nan=False), st.integers(0, 20000).map(lambda n: n / 1000), st.integers(0, 160).map(lambda n: n / 8),
), min_size=1, max_size=300))
def test_rounding(spark, values):
    import numpy as np

    assert apply(spark, round_exact, values, "double") == [round(v, 2) for v in values]
    assert apply(spark, round_frame, values, "double") == [float(np.round(np.array([v]), 2)[0]) for v in values]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(
    st.text(alphabet="0123456789.,$ -+eEd", max_size=14), st.sampled_from(["No disponible", "nan", "$1.000,50"]),
), min_size=1, max_size=200))
def test_generated_prices(spark, values):
    def expected(value):
        if value.lower() in ("no disponible", "nan"):
            return 0.0
        try:
            return float(value.replace("$", "").replace(" ", "").replace(".", "").replace(",", "."))
        except ValueError:
            return 0.0

    assert apply(spark, parse_price, values) == [expected(v) for v in values]


WORDS = ["Hace", "hora", "hours", "día", "days", "semana", "week", "mes", "month", "3", "12", "x", "2024-01-05", "-", "  "]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS), max_size=5).map(" ".join), min_size=1, max_size=200))
def test_generated_dates(spark, values):
    moment = as_of_column(AS_OF)
    assert apply(spark, lambda x: parse_posted_at(x, moment), values) == [_posted(v) for v in values]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="ab Áñ-1'\n\r\t\xa0 ", max_size=12), min_size=1, max_size=200))
def test_generated_texts(spark, values):
    assert apply(spark, text.strip, values) == [v.strip() for v in values]
    assert apply(spark, text.collapse_spaces, values) == [re.sub(r"\s+", " ", v) for v in values]
    assert apply(spark, lambda x: text.title_case(F.lower(x)), values) == [v.lower().title() for v in values]
    cleaned = [v.strip().replace("\n", " ").replace("\r", " ") if v else fv.NOT_AVAILABLE for v in values]
    assert apply(spark, text.clean_text, values) == cleaned
    assert apply(spark, text.snippet, values) == [v.strip()[:200] + "..." for v in values]


def test_texts(spark):
    check(spark, text.clean_text, [(None, "No disponible"), ("", "No disponible"), ("N/A", "No disponible"), (" N/A", "N/A"),
                                   ("Desconocido", "No disponible"), ("Sin información", "Sin información"), ("  ", ""), ("a\r\nb ", "a  b")])
    check(spark, lambda x: text.clean_text(x, fv.POSTING_SENTINELS), [("Sin información", "No disponible")])
    check(spark, text.clean_price_text, [(None, fv.NO_PRICE), ("", fv.NO_PRICE), ("N/A", fv.NO_PRICE), ("$5 ", "$5"), (" 5 ", "$5"), (" $5", "$$5")])
    check(spark, text.na_to_null, [("N/A", None), ("null", None), ("", None), (" ", " "), ("n/a", None), ("Nulo", "Nulo")])
    check(spark, text.canonical_url, [("http://a/b?c#d", "http://a/b"), ("http://a/b#d?c", "http://a/b"), ("x", "x")])
    check(spark, lambda x: text.absolute_listing_url(x, "H"), [("/a", "H/a"), ("http://b", "http://b"), ("b", None), ("", None), (None, None)])
    check(spark, lambda x: text.absolute_posting_url(x, "H"), [("/a", "H/a"), ("http://b", "http://b"), ("b", "Hb"), ("", None), (None, None)])


def test_places(spark):
    check(spark, labels.location_text, [(" Ciudad   Sur \n", "Ciudad Sur"), ("Rosario", fv.NOT_FOUND), (None, fv.NOT_FOUND)])
    check(spark, labels.location_mode, [("Argentina (Híbrido o remoto)", "Híbrido"), ("Remoto", "Remoto"), ("presencial", "Presencial"),
                                        ("Argentina", fv.NOT_FOUND), ("x", fv.NOT_FOUND), (None, fv.NOT_FOUND)])
    check(spark, labels.pick_company, [(["Argentina", " ", " ACME "], "ACME"), (["Remoto"], fv.NOT_FOUND), ([], fv.NOT_FOUND)], "array<string>")
    check(spark, labels.pick_level, [(["Jornada", '"Senior"\n  \'nivel\' '], "Senior nivel"), (["x"], fv.NOT_AVAILABLE), ([], fv.NOT_AVAILABLE)],
          "array<string>")
    check(spark, labels.page_status, [("un Captcha", "blocked"), ("x", "thin"), (None, "thin"), ("x" * 200, "ok"), (" " * 300, "thin")])


def test_date_pick(spark):
    rows = spark.createDataFrame(
        [(["2024-01-01"], ["hoy"]), ([""], ["hoy"]), ([], [" hoy "]), ([], [""]), ([], [])], "a array<string>, t array<string>")
    got = [r.y for r in rows.select(labels.pick_posting_date(F.col("a"), F.col("t")).alias("y")).collect()]
    assert got == ["2024-01-01", fv.NOT_FOUND, "hoy", fv.NOT_FOUND, fv.NOT_FOUND]


def test_exactness_of_whitespace():
    assert set(fv.WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}
    assert math.isclose(Weights().tiers[0][4], 50000.0)
