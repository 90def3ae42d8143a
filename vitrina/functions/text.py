"""Text normalisers as Columns. All of them stay in JVM code generation; none calls Python."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from vitrina import fixed_values as fv


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (`trim` alone removes only spaces)."""
    return F.btrim(text, F.lit(fv.WHITESPACE))


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " ")


def has_any(lowered: Column, words: Sequence[str]) -> Column:
    """True when the already lower-cased text contains one of the words."""
    return reduce(lambda a, b: a | b, [lowered.contains(word) for word in words])


def first_label(lowered: Column, rules, otherwise) -> Column:
    """Label of the first rule `(words, label)` with a hit."""
    chain = F
    for words, label in rules:
        chain = chain.when(has_any(lowered, words), label)
    return chain.otherwise(otherwise)


def na_to_null(text: Column) -> Column:
    """NULL for every text that a CSV reader of the pandas family takes as missing."""
    return F.when(~text.isin(*fv.NA_TOKENS), text)


def clean_text(text: Column, sentinels: Sequence[str] = fv.LISTING_SENTINELS) -> Column:
    """Export form of a text. The sentinel test sees the untrimmed value, so white space alone ends up as ''."""
    missing = text.isNull() | (text == "") | text.isin(*sentinels)
    return F.when(missing, fv.NOT_AVAILABLE).otherwise(F.translate(strip(text), "\n\r", "  "))


def clean_price_text(price: Column) -> Column:
    missing = price.isNull() | price.isin("", fv.MISSING)
    stripped = strip(price)
    return (
        F.when(missing, fv.NO_PRICE)
        .when(price.startswith("$"), stripped)
        .otherwise(F.concat(F.lit("$"), stripped))
    )


def clean_vendor(vendor: Column) -> Column:
    missing = vendor.isNull() | (F.lower(vendor) == fv.NOT_AVAILABLE.lower())
    return F.when(missing, fv.NO_VENDOR).otherwise(vendor)


def is_yes(text: Column, words: Sequence[str]) -> Column:
    return F.coalesce(F.lower(text).isin(*words), F.lit(False))


def is_available(text: Column) -> Column:
    return is_yes(text, fv.AVAILABLE_WORDS)


def has_free_shipping(text: Column) -> Column:
    return is_yes(text, fv.FREE_SHIPPING_WORDS)


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters (`initcap` restarts only after spaces)."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def snippet(text: Column, chars: int = fv.SNIPPET_CHARS) -> Column:
    """First characters of the trimmed text; the dots are always appended."""
    return F.concat(F.substring(strip(text), 1, chars), F.lit("..."))


def absolute_listing_url(href: Column, host: str) -> Column:
    """`/path` gets the host, `http...` stays, anything else is NULL."""
    return F.when(href.startswith("/"), F.concat(F.lit(host), href)).when(href.startswith("http"), href)


def absolute_posting_url(href: Column, host: str) -> Column:
    """`http...` stays, any other non-empty reference gets the host in front."""
    return F.when(href.startswith("http"), href).when(href != "", F.concat(F.lit(host), href))


def canonical_url(url: Column) -> Column:
    """Url without query and fragment."""
    return F.substring_index(F.substring_index(url, "?", 1), "#", 1)
