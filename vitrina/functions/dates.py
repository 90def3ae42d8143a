"""Posting dates: ISO dates and relative texts against one `as_of` moment, and age bands."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vitrina import fixed_values as fv
from vitrina.functions.text import has_any

_ISO_DAY = r"^[0-9]{4}-(1[0-2]|0?[1-9])-(3[01]|[12][0-9]|0?[1-9]| [1-9])\z"
_CALENDAR_START = "0001-01-01"  # moments before it are not dates of the snapshots and take the default
_MICROS_PER_DAY = 86_400_000_000


def as_of_column(as_of: str | None) -> Column:
    """The moment of analysis as TIMESTAMP_NTZ: the given text, or one reading of the clock for the whole query."""
    return F.localtimestamp() if as_of is None else F.lit(as_of).cast("timestamp_ntz")


def parse_posted_at(text: Column, as_of: Column, strict_units: bool = False) -> Column:
    """Publication moment of a posting.

    Only the first unit whose word occurs counts; without digits, or without any unit, the default of `as_of` minus
    twelve hours applies. `hace` belongs to the day unit, so `Hace 2 semanas` is two days unless `strict_units` is set.
    """
    lowered = F.lower(text)
    default = F.timestamp_add("HOUR", F.lit(-fv.DATE_DEFAULT_HOURS), as_of)
    day = F.when(
        F.length(text).between(8, 10) & text.contains("-") & text.rlike(_ISO_DAY) & ~text.startswith("0000"),
        F.replace(text, F.lit(" "), F.lit("")).try_cast("date"),
    ).cast("timestamp_ntz")
    amount = F.regexp_extract(lowered, "([0-9]+)", 1).try_cast("bigint")
    unit_hours = F
    for words, hours in fv.STRICT_DATE_UNITS if strict_units else fv.DATE_UNITS:
        unit_hours = unit_hours.when(has_any(lowered, words), hours)
    hours = F.try_multiply(amount, unit_hours.cast("bigint")).try_cast("int")
    moment = F.timestamp_add("HOUR", -hours, as_of)
    relative = F.when(moment >= F.lit(_CALENDAR_START).cast("timestamp_ntz"), moment)
    known = F.when(~lowered.isin(*fv.DATE_MISSING), F.coalesce(day, relative))
    return F.coalesce(known, default)


def age_band(moment: Column, as_of: Column) -> Column:
    """Band of whole elapsed days: 0, up to 7 (a moment in the future counts here too), more."""
    micros = F.timestamp_diff("MICROSECOND", moment, as_of)
    return (
        F.when((micros >= 0) & (micros < _MICROS_PER_DAY), fv.AGE_FIRST)
        .when(micros < 8 * _MICROS_PER_DAY, fv.AGE_WEEK)
        .otherwise(fv.AGE_OLDER)
    )
