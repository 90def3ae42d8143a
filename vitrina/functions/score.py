"""Value score of a listing: reputation, availability, shipping and a banded price term."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from vitrina import fixed_values as fv
from vitrina.functions.numbers import round_exact


@dataclass(frozen=True)
class Weights:
    """Fixed values of the score. A price tier is `(edge, inclusive, top, start, width)`: top - (price - start) / width."""

    reputation: tuple[tuple[str, float], ...] = (
        (fv.REPUTATION_GOOD, 4.0),
        (fv.REPUTATION_REGULAR, 2.0),
        (fv.REPUTATION_NEW, 1.0),
        (fv.REPUTATION_BAD, 0.0),
        (fv.REPUTATION_NONE, 0.0),
    )
    available: float = 2.0
    free_shipping: float = 1.0
    tiers: tuple[tuple[float, bool, float, float, float], ...] = (
        (100000.0, False, 3.0, 0.0, 50000.0),
        (500000.0, True, 2.0, 100000.0, 200000.0),
        (float("inf"), True, 1.0, 500000.0, 500000.0),
    )


def price_term(price: Column, tiers) -> Column:
    chain = F.when(~(price > 0), 0.0)
    for edge, inclusive, top, start, width in tiers:
        inside = price <= edge if inclusive else price < edge
        chain = chain.when(inside, top - (price - start) / width)
    return F.greatest(F.lit(0.0), chain.otherwise(0.0))


def value_points(
    reputation: Column, available: Column, free_shipping: Column, price: Column, weights: Weights = Weights()
) -> Column:
    """The value score before it is rounded."""
    points = F.when(F.lit(False), 0.0)
    for label, value in weights.reputation:
        if value:  # others count 0 anyway
            points = points.when(reputation == label, value)
    base = (
        points.otherwise(0.0)
        + F.when(available, weights.available).otherwise(0.0)
        + F.when(free_shipping, weights.free_shipping).otherwise(0.0)
    )
    return base + price_term(price, weights.tiers)


def value_score(
    reputation: Column, available: Column, free_shipping: Column, price: Column, weights: Weights = Weights()
) -> Column:
    """Rounding names its argument many times; over large tables, round a column that holds `value_points`."""
    return round_exact(value_points(reputation, available, free_shipping, price, weights))
