"""Keyword classifiers: the first rule that hits gives the label."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vitrina import fixed_values as fv
from vitrina.functions.text import collapse_spaces, first_label, has_any, strip, title_case


def classify_reputation(text: Column, lowered: Column | None = None) -> Column:
    """`lowered`: a column that holds the text in lower case already."""
    lowered = F.lower(text) if lowered is None else lowered
    missing = text.isNull() | (lowered == fv.NOT_AVAILABLE.lower())
    return F.when(missing, fv.REPUTATION_NONE).otherwise(
        first_label(lowered, fv.REPUTATION_RULES, fv.REPUTATION_NONE)
    )


def classify_experience(text: Column) -> Column:
    lowered = F.lower(text)
    missing = text.isNull() | lowered.isin(fv.NOT_AVAILABLE.lower(), "nan")
    return (
        F.when(missing, fv.NOT_SPECIFIED)
        .when(has_any(lowered, fv.DEVELOPER_WORDS), first_label(lowered, fv.DEVELOPER_LEVEL_RULES, fv.LEVEL_MID))
        .otherwise(first_label(lowered, fv.LEVEL_RULES, fv.NOT_SPECIFIED))
    )


def classify_modality(text: Column) -> Column:
    lowered = F.lower(text)
    missing = text.isNull() | (lowered == fv.NOT_AVAILABLE.lower())
    return F.when(missing, fv.NOT_SPECIFIED).otherwise(first_label(lowered, fv.MODE_RULES, title_case(lowered)))


def is_location(text: Column) -> Column:
    return has_any(F.lower(text), fv.LOCATION_WORDS)


def pick_company(candidates: Column) -> Column:
    """First non-blank candidate that does not read like a place."""
    kept = F.filter(candidates, lambda text: (strip(text) != "") & ~is_location(text))
    return F.coalesce(strip(F.get(kept, F.lit(0))), F.lit(fv.NOT_FOUND))


def pick_location(candidates: Column) -> Column:
    """First candidate that reads like a place, still in its raw form; NULL if there is none."""
    return F.get(F.filter(candidates, is_location), F.lit(0))


def location_text(location: Column) -> Column:
    kept = F.when(is_location(location), collapse_spaces(strip(location)))
    return F.coalesce(kept, F.lit(fv.NOT_FOUND))


def location_mode(location: Column) -> Column:
    """Work mode named inside a place text."""
    return F.when(
        is_location(location), first_label(F.lower(location), fv.CARD_MODE_RULES, fv.NOT_FOUND)
    ).otherwise(fv.NOT_FOUND)


def pick_level(candidates: Column) -> Column:
    """First candidate with a level keyword, without quotes and with single spaces."""
    cleaned = F.transform(
        candidates, lambda text: strip(collapse_spaces(F.translate(text, "\"'", "")))
    )
    kept = F.filter(cleaned, lambda text: has_any(F.lower(text), fv.LEVEL_WORDS))
    return F.coalesce(F.get(kept, F.lit(0)), F.lit(fv.NOT_AVAILABLE))


def pick_posting_date(attribute: Column, text: Column) -> Column:
    """Date of a card: the machine attribute if such an element exists, else the first text element.

    Both arguments are arrays with one value per element found. The first element decides even when it is empty.
    """
    first_attr, first_text = F.get(attribute, F.lit(0)), F.get(text, F.lit(0))
    found = F.when(F.size(attribute) > 0, F.when(first_attr != "", first_attr)).otherwise(
        F.when(first_text != "", strip(first_text))
    )
    return F.coalesce(found, F.lit(fv.NOT_FOUND))


def page_status(text: Column) -> Column:
    return (
        F.when(has_any(F.lower(text), fv.BLOCK_WORDS), "blocked")
        .when(F.length(strip(F.coalesce(text, F.lit("")))) < fv.THIN_PAGE_CHARS, "thin")
        .otherwise("ok")
    )
