"""Prices: text to number, and banding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from vitrina import fixed_values as fv
from vitrina.functions.text import strip


def price_digits(text: Column) -> Column:
    """A price text as a number is written: no thousands separators, a decimal point."""
    return strip(F.translate(text, ",$ .", "."))


def parse_price(text: Column, digits: Column | None = None) -> Column:
    """`$1.234.567,89` to 1234567.89; missing or unreadable text to 0.

    Dots are thousands separators and the comma is the decimal mark, whatever the text looks like. The character guard
    keeps out suffixes such as `12d` that a cast to double would accept. `digits`: a column that holds `price_digits` already.
    """
    missing = text.isNull() | F.lower(text).isin(fv.NOT_AVAILABLE.lower(), "nan")
    number = price_digits(text) if digits is None else digits
    plain = F.translate(number, "0123456789eE.+-", "") == ""
    return F.when(missing, 0.0).otherwise(F.coalesce(F.when(plain, number.try_cast("double")), F.lit(0.0)))


@dataclass(frozen=True)
class Bands:
    """Ordered `(edge, label, inclusive)` upper edges, and the label beyond the last edge."""

    edges: tuple[tuple[float, str, bool], ...]
    beyond: str


PRICE_BANDS = Bands(((100000.0, "Bajo", False), (500000.0, "Medio", True)), "Alto")
PRICE_BANDS_SIX = Bands(
    (
        (50000.0, "Muy Bajo", False),
        (100000.0, "Bajo", False),
        (300000.0, "Medio-Bajo", True),
        (500000.0, "Medio", True),
        (1000000.0, "Alto", True),
    ),
    "Premium",
)


def price_band(price: Column, bands: Bands = PRICE_BANDS) -> Column:
    chain = F
    for edge, label, inclusive in bands.edges:
        chain = chain.when(price <= edge if inclusive else price < edge, label)
    return chain.otherwise(bands.beyond)
