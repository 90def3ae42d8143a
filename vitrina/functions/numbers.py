"""Two ways to round to cents that differ only on ties."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_frame(value: Column) -> Column:
    """Two decimals as numpy rounds an array: half-even on the binary product with 100."""
    return F.rint(value * 100.0) / 100.0


def round_exact(value: Column) -> Column:
    """Two decimals by the exact binary value, half-even: what Python's `round(x, 2)` returns. For |x| below 2^25.

    The value is split into a high part on a 2^-20 grid and an exact rest, so its distance to the midpoint between two
    cents is computed without rounding error.
    """
    high = F.floor(value * 1048576.0) / 1048576.0
    low = value - high
    cents = F.floor(value * 100.0)
    distance = (high * 200.0 - (cents * 2 + 1)) + low * 200.0
    # value * 100 may itself have rounded up to a whole number of cents; the distance then is -1 or a little less.
    even = F.pmod(cents, F.lit(2)) == 0
    up = (distance > 0) | ((distance == 0) & ~even)
    return F.when(up, cents + 1).otherwise(cents) / 100.0
