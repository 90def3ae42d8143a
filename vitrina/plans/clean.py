"""Typed columns on top of a snapshot, and the export form of freshly extracted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitrina import fixed_values as fv
from vitrina.functions import labels, score, text
from vitrina.functions.dates import age_band, as_of_column, parse_posted_at
from vitrina.functions.numbers import round_exact
from vitrina.functions.prices import PRICE_BANDS, Bands, parse_price, price_band, price_digits
from vitrina.operators.ingest import valid_listing, valid_posting


def null_missing(rows: DataFrame) -> DataFrame:
    """Every text that stands for a missing value becomes NULL."""
    texts = {name for name, kind in rows.dtypes if kind == "string"}
    return rows.select(
        *[text.na_to_null(F.col(name)).alias(name) if name in texts else F.col(name) for name in rows.columns]
    )


def clean_listings(
    listings: DataFrame, bands: Bands = PRICE_BANDS, weights: score.Weights = score.Weights(), nulled: bool = False
) -> DataFrame:
    """Listing snapshot plus price, seller, reputation, flags, band and value score. Stateless, one projection chain.

    `nulled`: texts for missing values are NULL already, as a scanned snapshot has them.
    """
    # What is named many times is a column of its own: worked out once a row, and the code of a row stays short enough to be compiled.
    rows = (listings if nulled else null_missing(listings)).withColumns(
        {"__lowered": F.lower("reputacion_vendedor"), "__digits": price_digits(F.col("precio"))}
    )
    rows = rows.withColumns(
        {
            "precio_numerico": parse_price(F.col("precio"), F.col("__digits")),
            "vendedor_limpio": text.clean_vendor(F.col("vendedor")),
            "reputacion_limpia": labels.classify_reputation(F.col("reputacion_vendedor"), F.col("__lowered")),
            "disponible_bool": text.is_available(F.col("disponible")),
            "envio_gratis_bool": text.has_free_shipping(F.col("envio_gratis")),
        }
    )
    rows = rows.withColumns(
        {
            "rango_precio": price_band(F.col("precio_numerico"), bands),
            "__points": score.value_points(
                F.col("reputacion_limpia"),
                F.col("disponible_bool"),
                F.col("envio_gratis_bool"),
                F.col("precio_numerico"),
                weights,
            ),
        }
    )
    # As a function of the points: rounding is then compiled apart from the rest, which alone is about as long as may be.
    score_of = F.get(F.transform(F.array("__points"), round_exact), F.lit(0))
    return rows.withColumn("puntaje_valor", score_of).drop("__lowered", "__digits", "__points")


def clean_postings(
    postings: DataFrame, as_of: str | None = None, strict_units: bool = False, nulled: bool = False
) -> DataFrame:
    """Posting snapshot plus publication moment, seniority, work mode and age band. `nulled` as in `clean_listings`."""
    moment = as_of_column(as_of)
    rows = (postings if nulled else null_missing(postings)).withColumns(
        {
            "fecha_publicacion_dt": parse_posted_at(F.col("fecha_publicacion"), moment, strict_units),
            "nivel_experiencia_limpio": labels.classify_experience(F.col("nivel_experiencia")),
            "modalidad_limpia": labels.classify_modality(F.col("modalidad")),
        }
    )
    return rows.withColumn("categoria_fecha", age_band(F.col("fecha_publicacion_dt"), moment))


def export_listing_rows(listings: DataFrame) -> DataFrame:
    """The ten export columns, texts cleaned, before validation."""
    cleaned = {"producto", "vendedor", "ubicacion", "reputacion_vendedor", "categoria"}
    return listings.select(
        *[
            text.clean_text(F.col(name)).alias(name)
            if name in cleaned
            else text.clean_price_text(F.col(name)).alias(name)
            if name == "precio"
            else F.col(name)
            for name in fv.LISTING_COLUMNS
        ]
    )


def export_posting_rows(postings: DataFrame) -> DataFrame:
    """The eleven export columns, texts cleaned, before validation."""
    kept = {"indice", "fecha_extraccion", "url_empleo"}
    return postings.select(
        *[
            F.col(name).cast("string").alias(name)
            if name in kept
            else text.clean_text(F.col(name), fv.POSTING_SENTINELS).alias(name)
            for name in fv.POSTING_COLUMNS
        ]
    )


def valid_listing_rows(exported: DataFrame) -> DataFrame:
    return exported.where(valid_listing(F.col("producto"), F.col("precio")))


def valid_posting_rows(exported: DataFrame) -> DataFrame:
    return exported.where(valid_posting(F.col("titulo_puesto"), F.col("empresa")))
