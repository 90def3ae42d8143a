"""Grouped, ranked and summary reports over cleaned listings and postings.

Groupings are plain aggregates: Spark combines them before the shuffle, also the distinct counts, so a hot group costs no
more than any other. Sorted outputs get all keys as tie-break: the order is total and range partitions split evenly.

Every grouped report exists twice: from rows, and from `listing_groups` or `posting_groups`, which hold the groups of all of them
as grouping sets of one pass over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitrina import fixed_values as fv
from vitrina.functions.dates import as_of_column
from vitrina.functions.numbers import round_frame
from vitrina.operators import ranks
from vitrina.sources.staging import stage_table

RANKING_COLUMNS = (
    "producto", "precio_numerico", "reputacion_limpia", "disponible_bool",
    "envio_gratis_bool", "puntaje_valor", "categoria", "vendedor_limpio",
)


def _listing_measures() -> dict[str, Column]:
    price = F.col("precio_numerico")
    return {
        "cantidad_productos": F.count("producto"),
        "precio_promedio": round_frame(F.avg(price)),
        "precio_minimo": round_frame(F.min(price)),
        "precio_maximo": round_frame(F.max(price)),
        "productos_disponibles": F.count_if("disponible_bool"),
        "productos_envio_gratis": F.count_if("envio_gratis_bool"),
    }


_BAND_COLUMNS = ("cantidad_productos", "precio_promedio", "precio_minimo", "precio_maximo")
_VENDOR_COLUMNS = ("cantidad_productos", "precio_promedio", "productos_disponibles", "productos_envio_gratis")


def _measured(rows, names) -> DataFrame:
    measures = _listing_measures()
    return rows.agg(*[measures[name].alias(name) for name in names])


def report_price_band(listings: DataFrame) -> DataFrame:
    return _measured(listings.groupBy("rango_precio"), _BAND_COLUMNS).orderBy("rango_precio")


def report_vendor(listings: DataFrame) -> DataFrame:
    counts = _measured(listings.groupBy("vendedor_limpio", "reputacion_limpia"), _VENDOR_COLUMNS)
    return counts.orderBy(F.desc("cantidad_productos"), "vendedor_limpio", "reputacion_limpia")


def listing_groups(listings: DataFrame) -> DataFrame:
    """One pass: groups by price band, by seller and reputation, by the first digit of the price (for the median), and of all rows.

    `grouping` tells them apart: BANDS, VENDORS, DIGITS, ALL.
    """
    keys = [F.col(name) for name in ("rango_precio", "vendedor_limpio", "reputacion_limpia", "prefix")]
    rows = listings.withColumn("prefix", ranks.top_digit(F.col("precio_numerico")))
    return rows.groupingSets([keys[:1], keys[1:3], keys[3:], []], *keys).agg(
        F.grouping_id().cast("int").alias("grouping"), F.count("*").alias("n"), F.sum("precio_numerico").alias("price_sum"),
        *[measure.alias(name) for name, measure in _listing_measures().items()],
    )


# Bits of the keys that a group is not by.
BANDS, VENDORS, DIGITS, ALL = 0b0111, 0b1001, 0b1110, 0b1111


def price_band_of(groups: DataFrame) -> DataFrame:
    return groups.where(F.col("grouping") == BANDS).select("rango_precio", *_BAND_COLUMNS).orderBy("rango_precio")


def vendor_of(groups: DataFrame) -> DataFrame:
    counts = groups.where(F.col("grouping") == VENDORS).select("vendedor_limpio", "reputacion_limpia", *_VENDOR_COLUMNS)
    return counts.orderBy(F.desc("cantidad_productos"), "vendedor_limpio", "reputacion_limpia")


def _ranking_order() -> list[Column]:
    return [F.desc("puntaje_valor"), *[F.asc(name) for name in RANKING_COLUMNS if name != "puntaje_valor"]]


def report_value_ranking(listings: DataFrame, limit: int | None = None) -> DataFrame:
    """All listings by value score, or the best `limit`. The full ranking is a range-partitioned sort."""
    ranked = listings.select(*RANKING_COLUMNS).orderBy(*_ranking_order())
    return ranked if limit is None else ranked.limit(limit)


def report_value_ranking_placed(listings: DataFrame, folder: str | None = None) -> DataFrame:
    """The full ranking with the 0-based `place` of every listing; equal listings take neighbouring places."""
    return ranks.with_place(listings.select(*RANKING_COLUMNS), _ranking_order(), "place", folder)


def report_vendor_placed(listings: DataFrame, folder: str | None = None) -> DataFrame:
    """The vendor report with the 0-based `place` of every group."""
    order = (F.desc("cantidad_productos"), F.asc("vendedor_limpio"), F.asc("reputacion_limpia"))
    return ranks.with_place(_measured(listings.groupBy("vendedor_limpio", "reputacion_limpia"), _VENDOR_COLUMNS), order, "place", folder)


def _posting_measures() -> list[Column]:
    return [F.count("titulo_puesto").alias("cantidad_empleos"), F.count_distinct("empresa").alias("empresas_unicas")]


def report_posting_age(postings: DataFrame) -> DataFrame:
    return postings.groupBy("categoria_fecha").agg(*_posting_measures()).orderBy("categoria_fecha")


def report_experience(postings: DataFrame) -> DataFrame:
    counts = postings.groupBy("nivel_experiencia_limpio").agg(*_posting_measures())
    return counts.orderBy(F.desc("cantidad_empleos"), "nivel_experiencia_limpio")


def report_modality_location(postings: DataFrame) -> DataFrame:
    counts = postings.where("ubicacion IS NOT NULL").groupBy("modalidad_limpia", "ubicacion").agg(*_posting_measures())
    return counts.orderBy(F.desc("cantidad_empleos"), "modalidad_limpia", "ubicacion")


def _modes() -> list[Column]:
    mode = F.col("modalidad_limpia")
    return [
        F.count("*").alias("total_empleos_linkedin"),
        F.count_if(mode == fv.MODE_REMOTE).alias("empleos_remotos"),
        F.count_if(mode == fv.MODE_ONSITE).alias("empleos_presenciales"),
        F.count_if(mode == fv.MODE_HYBRID).alias("empleos_hibridos"),
    ]


def posting_groups(postings: DataFrame) -> DataFrame:
    """One pass: groups by age band, by seniority, by work mode and place, and of all rows (`grouping`: AGES, LEVELS, PLACES, ALL)."""
    rows = postings.withColumn("mode_key", F.col("modalidad_limpia"))  # the modes are counted in groups that are not by mode
    keys = [F.col(name) for name in ("categoria_fecha", "nivel_experiencia_limpio", "mode_key", "ubicacion")]
    return rows.groupingSets([keys[:1], keys[1:2], keys[2:], []], *keys).agg(
        F.grouping_id().cast("int").alias("grouping"), *_posting_measures(), *_modes()
    )


AGES, LEVELS, PLACES = 0b0111, 0b1011, 0b1100


def posting_age_of(groups: DataFrame) -> DataFrame:
    return groups.where(F.col("grouping") == AGES).select("categoria_fecha", "cantidad_empleos", "empresas_unicas").orderBy("categoria_fecha")


def experience_of(groups: DataFrame) -> DataFrame:
    counts = groups.where(F.col("grouping") == LEVELS).select("nivel_experiencia_limpio", "cantidad_empleos", "empresas_unicas")
    return counts.orderBy(F.desc("cantidad_empleos"), "nivel_experiencia_limpio")


def modality_location_of(groups: DataFrame) -> DataFrame:
    counts = groups.where((F.col("grouping") == PLACES) & F.col("ubicacion").isNotNull()).select(
        F.col("mode_key").alias("modalidad_limpia"), "ubicacion", "cantidad_empleos", "empresas_unicas"
    )
    return counts.orderBy(F.desc("cantidad_empleos"), "modalidad_limpia", "ubicacion")


def exact_median(rows: DataFrame, column: str) -> DataFrame:
    """One row `median`: the exact median of a double column, without bringing its values together in one task."""
    return ranks.exact_median(rows, F.col(column))


def _summary_row(totals: DataFrame, modes: DataFrame, median: DataFrame, as_of: str | None) -> DataFrame:
    """One row from one row of each."""
    stamp = F.date_format(as_of_column(as_of), "yyyy-MM-dd HH:mm:ss").alias("fecha_analisis")
    counts = ("total_empleos_linkedin", "empleos_remotos", "empleos_presenciales", "empleos_hibridos")
    rows = totals.crossJoin(F.broadcast(median)).crossJoin(F.broadcast(modes))
    return rows.select(
        stamp, F.coalesce("n", F.lit(0)).alias("total_productos_ml"), F.coalesce(counts[0], F.lit(0)).alias(counts[0]),
        round_frame(F.col("price_sum") / F.col("n")).alias("precio_promedio_ml"), round_frame(F.col("median")).alias("precio_mediano_ml"),
        F.coalesce("available", F.lit(0)).alias("productos_disponibles"), F.coalesce("free", F.lit(0)).alias("productos_envio_gratis"),
        *[F.coalesce(name, F.lit(0)).alias(name) for name in counts[1:]],
    )


def summary(listings: DataFrame, postings: DataFrame, as_of: str | None = None) -> DataFrame:
    """One row of totals. The listing totals come from the same pass that counts the first digits of the prices for the median."""
    price = F.col("precio_numerico")
    first = listings.groupBy(ranks.top_digit(price).alias("prefix")).agg(
        F.count("*").alias("n"), F.sum(price).alias("price_sum"),
        F.count_if("disponible_bool").alias("available"), F.count_if("envio_gratis_bool").alias("free"),
    )
    first = stage_table(first)
    totals = first.agg(*[F.sum(name).alias(name) for name in ("n", "price_sum", "available", "free")])
    median = ranks.exact_median(listings, price, first.select("prefix", "n"))
    return _summary_row(totals, postings.agg(*_modes()), median, as_of)


def summary_of(
    listing_groups: DataFrame, posting_groups: DataFrame, listings: DataFrame, as_of: str | None = None, folder: str | None = None
) -> DataFrame:
    """The summary from the groups; the rows are read once more, for the prices that share the median's first digit."""
    names = {"n": "n", "price_sum": "price_sum", "productos_disponibles": "available", "productos_envio_gratis": "free"}
    every = listing_groups.where(F.col("grouping") == ALL)
    totals = every.agg(*[F.max(name).alias(alias) for name, alias in names.items()])
    counts = ("total_empleos_linkedin", "empleos_remotos", "empleos_presenciales", "empleos_hibridos")
    modes = posting_groups.where(F.col("grouping") == ALL).agg(*[F.max(name).alias(name) for name in counts])
    digits = listing_groups.where(F.col("grouping") == DIGITS).select("prefix", "n")
    median = ranks.exact_median(listings, F.col("precio_numerico"), digits, folder)
    return _summary_row(totals, modes, median, as_of)


def category_counts(listings: DataFrame) -> DataFrame:
    """Listings per category, with the number of categories beside each."""
    category = F.when(F.col("categoria") != "", F.col("categoria"))
    counts = listings.groupBy(F.coalesce(category, F.lit(fv.NO_CATEGORY)).alias("categoria")).agg(
        F.count("*").alias("cantidad_productos")
    )
    # Counting through the aggregate column keeps both uses of `counts` alike, so that its exchange is computed once.
    number = counts.agg(F.count_if(F.col("cantidad_productos") > 0).alias("categorias"))
    return counts.crossJoin(F.broadcast(number))


def category_price_stats(listings: DataFrame) -> DataFrame:
    """Mean, count and sample deviation of the price per category; rows without category are left out."""
    price = F.col("precio_numerico")
    return (
        listings.where("categoria IS NOT NULL")
        .groupBy("categoria")
        .agg(F.avg(price).alias("mean"), F.count(price).alias("count"), F.stddev_samp(price).alias("std"))
        .orderBy("categoria")
    )


def modality_distribution(postings: DataFrame) -> DataFrame:
    """Postings per work mode as extracted."""
    return postings.groupBy("modalidad").agg(F.count("*").alias("cantidad"))


def average_price_simple(listings: DataFrame) -> DataFrame:
    """Mean of whole prices: `$` and dots removed, `N/A` skipped; texts that are no whole number do not count."""
    whole = F.translate(F.col("precio"), "$.", "").try_cast("bigint")
    return listings.where(F.col("precio") != fv.MISSING).agg(F.avg(whole).alias("precio_promedio"))
