"""Whole numbers that sort like values of other types, so that ranks can be found by counting digits."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, functions as F

_NULL = -(2**40)
INFINITE = 2047 << 52


def double_image(value: Column) -> Column:
    """The bits of a double as a signed 64-bit number in the order of the values: -0.0 as 0.0, NaN above infinity, NULL stays.

    Exponent and mantissa are split off by divisions by powers of two, which are exact.
    """
    size = F.abs(value)
    tiny = size < F.lit(2.0**-1022)
    guess = F.floor(F.log2(size))
    near = size / F.pow(F.lit(2.0), guess)  # log2 may be off by one next to a power of two
    exponent = guess + F.when(near >= 2.0, 1).when(near < 1.0, -1).otherwise(0)
    part = ((size / F.pow(F.lit(2.0), exponent) - 1.0) * F.lit(2.0**52)).cast("long")
    bits = (
        F.when(F.isnan(value), F.lit(INFINITE + 1))
        .when(size == float("inf"), F.lit(INFINITE))
        .when(tiny, (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long"))
        .otherwise((exponent + 1023).cast("long") * F.lit(2**52) + part)
    )
    return F.when(value < 0, -bits).when(value.isNotNull(), bits)


def from_image(image: int) -> float:
    """The double with a given image."""
    if image > INFINITE:
        return math.nan
    return -from_image(-image) if image < 0 else struct.unpack("d", struct.pack("q", image))[0]


def text_images(text: Column, digits: int = 3) -> list[Column]:
    """The first bytes of a text, seven a number. Texts that differ later have equal images."""
    data = F.encode(text, "UTF-8")
    return [F.conv(F.rpad(F.hex(F.substring(data, 1 + 7 * k, 7)), 14, "0"), 16, 10).cast("long") for k in range(digits)]


def order_images(rows: DataFrame, name: str) -> tuple[list[Column], bool]:
    """Numbers of at most 33 bits (56 for texts) that, compared one after the other, follow a column in ascending order, NULL first.

    Also whether equal numbers mean equal values: not so for long texts and for decimals, which are compared as doubles.
    """
    column, kind = F.col(name), rows.schema[name].dataType.typeName()
    if kind in ("byte", "short", "integer", "boolean", "date"):
        images = [F.unix_date(column) if kind == "date" else column]
    elif kind in ("long", "float", "double", "decimal", "timestamp", "timestamp_ntz"):
        if kind == "long":
            whole = column
        elif kind in ("timestamp", "timestamp_ntz"):
            whole = F.unix_micros(column.cast("timestamp"))
        else:
            whole = double_image(column.cast("double"))
        images = [F.shiftright(whole, 32), whole.bitwiseAND(2**32 - 1)]
    elif kind == "string":
        images = text_images(column)
    else:
        raise TypeError(f"no order of numbers for column {name} of type {kind}")
    return [F.coalesce(image.cast("long"), F.lit(_NULL)) for image in images], kind not in ("string", "decimal")
