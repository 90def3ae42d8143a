"""Detail enrichment: overwrite fields of the first rows with values found on their detail pages.

Only the few rows that are to be enriched meet the details, and only the details of these rows are looked at. The chosen
rows and their updates are staged, so their sizes are known before the joins with the large tables are planned: if small,
they are broadcast, and neither the listings nor the details are shuffled just to find that out. Updates go back on the
unique order key of the rows, so neither a hot url nor a hot term concentrates rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from vitrina import fixed_values as fv
from vitrina.functions.text import snippet
from vitrina.operators import bloom
from vitrina.operators.ingest import first_rows
from vitrina.sources.staging import stage_table

Parse = Callable[[DataFrame], DataFrame]
# Parts the texts of a packed column; the other begins what stands in them for NULL, for itself and for the first.
_END, _MARK = "\x1f", "\x1e"


def latest_details(details: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """One row per url: the last fetched, ties settled by the remaining columns."""
    others = [name for name in details.columns if name not in (url, fetched_at)]
    return first_rows(details, [url], [F.col(fetched_at).desc(), *others]).drop(fetched_at)


def _merge(rows: DataFrame, updates: DataFrame, same_row: Column, fields: Sequence[str]) -> DataFrame:
    """Left join with `updates`, whose columns are prefixed; a field that is NULL there keeps its value."""
    joined = rows.join(updates, same_row, "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"__{name}"), F.col(name)).alias(name) if name in fields else F.col(name)
            for name in rows.columns
        ]
    )


def _prefixed(updates: DataFrame) -> DataFrame:
    return updates.select(*[F.col(name).alias(f"__{name}") for name in updates.columns])


def _same_url(left: Column, right: Column) -> Column:
    """Equal urls, in a form that makes both sides of the join shuffle for it.

    The details arrive partitioned by url; a join on the url alone would reuse that, and adaptive execution splits a hot
    partition only where the join reads two fresh shuffles. Details are one row per url, so the second shuffle is the
    cheap one.
    """
    return (left == right) & (F.xxhash64(left) == F.xxhash64(right))


def _update_chosen(
    rows: DataFrame, url: str, chosen: DataFrame, details: DataFrame, latest: Parse, keys: Sequence[str], fields: Sequence[str],
    folder: str | None = None,
) -> DataFrame:
    """Few rows to enrich: join these with their details, and bring the outcome back on the unique order key."""
    chosen = stage_table(chosen, folder)
    found = _prefixed(latest(of_chosen(details, chosen)))
    updates = stage_table(
        chosen.distinct().join(found, _same_url(F.col("url"), F.col("__url"))).select(*keys, F.col("url").alias("found_url"), *[F.col(f"__{n}").alias(n) for n in fields]),
        folder,
    )
    # Rows may share a key (a page stored twice); with the url, an update is one row, and no row is multiplied.
    same_row = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"__{name}")) for name in keys], F.col(url) == F.col("__found_url"))
    return _merge(rows, _prefixed(updates), same_row, fields)


def _packed(texts: Column) -> Column:
    """An array of texts as one text, to be shuffled: a row pays eight bytes a text, and padding, for texts often no longer."""
    marks = F.array_join(texts, "")
    marked = F.transform(texts, lambda t: F.replace(F.replace(t, F.lit(_MARK), F.lit(_MARK + "1")), F.lit(_END), F.lit(_MARK + "2")))
    odd = marks.contains(_MARK) | marks.contains(_END)
    return F.when(odd, F.array_join(marked, _END, _MARK + "0")).otherwise(F.array_join(texts, _END, _MARK + "0"))


def _unpacked(packed: Column, number: int) -> Column:
    """One of the texts, byte for byte."""
    part = F.substring_index(F.substring_index(packed, _END, number + 1), _END, -1)
    text = F.replace(F.replace(part, F.lit(_MARK + "2"), F.lit(_END)), F.lit(_MARK + "1"), F.lit(_MARK))
    return F.when(~part.contains(_MARK), part).when(part != _MARK + "0", text)


def _update_all(rows: DataFrame, url: str, details: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """All rows to enrich: one join on the url.

    Every row is shuffled, so its texts travel as one, and the hash of the url that it is sorted by is computed, not carried. Rows
    without url match nothing, so they get a hash of their own instead of meeting in one partition. The rows of a hot url are split by
    the skew handling of adaptive execution.
    """
    texts = [name for name, kind in rows.dtypes if kind == "string" and name != url]
    others = [name for name in rows.columns if name not in texts]
    carried = rows.select(*others, F.array(*texts).cast("array<string>").alias("__array"))
    carried = carried.select(*others, _packed(F.col("__array")).alias("__texts"))
    link = F.col(url)
    spread = F.xxhash64("__texts", *[name for name in keys if name in others])
    same = (F.when(link.startswith("http"), F.xxhash64(link)).otherwise(spread) == F.xxhash64("__url")) & (link == F.col("__url"))
    joined = carried.join(_prefixed(details.select("url", *fields)), same, "left")
    values = {name: F.col(name) for name in others} | {name: _unpacked(F.col("__texts"), number) for number, name in enumerate(texts)}
    return joined.select(
        *[(F.coalesce(F.col(f"__{name}"), values[name]) if name in fields else values[name]).alias(name) for name in rows.columns]
    )


def _unless(value: Column, sentinel: str) -> Column:
    return F.when(value != sentinel, value)


def chosen_listings(
    listings: DataFrame,
    term: str = "categoria",
    order_by: Sequence[str] = ("pos",),
    per_term: int | None = None,
) -> DataFrame:
    """Order key and url of the listings to enrich: the first `per_term` of each term, if they have a url."""
    chosen = listings.select(term, *order_by, F.col("url_producto").alias("url"))
    if per_term is not None:
        chosen = first_rows(chosen, [term], order_by, per_term)
    return chosen.where(F.col("url").startswith("http"))


def chosen_postings(
    postings: DataFrame, order_by: Sequence[str] = ("term_no", "pos"), limit: int | None = None
) -> DataFrame:
    """Order key and url of the postings to enrich: the first `limit` overall, if they have a url.

    The first rows come from a distributed top-k, never from a global row number.
    """
    chosen = postings.select(*order_by, F.col("url_empleo").alias("url"))
    if limit is not None:
        chosen = chosen.orderBy(*order_by).limit(limit)
    return chosen.where((F.col("url") != fv.NOT_FOUND) & F.col("url").startswith("http"))


def of_chosen(details: DataFrame, chosen: DataFrame) -> DataFrame:
    """The details (or unparsed detail pages) of the chosen rows only."""
    wanted = chosen.select(F.col("url").alias("__url"))
    return details.join(wanted, _same_url(F.col("url"), F.col("__url")), "left_semi")


def of_wanted(pages: DataFrame, rows: DataFrame, url: str) -> DataFrame:
    """Detail pages whose url a row may have: a filter of fixed size, so that pages nobody asks for are neither parsed nor shuffled."""
    links = rows.select(F.col(url).alias("key")).where(F.col("key").startswith("http"))
    return bloom.with_maybe(pages, F.col("url"), bloom.bitmaps(links), "__maybe").where("__maybe").drop("__maybe")


def enrich_listings(
    listings: DataFrame,
    details: DataFrame,
    term: str = "categoria",
    order_by: Sequence[str] = ("pos",),
    per_term: int | None = None,
    parse: Parse | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Place and reputation from the details for the first `per_term` listings of each term (None: all).

    `details`: url, fetched_at, ubicacion, reputacion_vendedor. `order_by` must number the rows of a term without ties.
    With `parse`, `details` are stored pages (url, html, fetched_at) that it turns into such rows: pages of chosen rows only, or,
    without `per_term`, those that a fixed-size filter of the urls lets through.
    Finding the chosen rows and their updates runs as jobs of its own; the result is lazy.
    """
    fields = ("ubicacion", "reputacion_vendedor")

    def latest(found: DataFrame) -> DataFrame:
        found = latest_details((parse(found) if parse else found).where(F.col("url").startswith("http")))
        return found.select("url", *[_unless(F.col(name), fv.UNKNOWN_PLACE).alias(name) for name in fields])

    if per_term is None:
        found = of_wanted(details, listings, "url_producto") if parse else details
        return _update_all(listings, "url_producto", latest(found), [term, *order_by], fields)
    chosen = chosen_listings(listings, term, order_by, per_term)
    return _update_chosen(listings, "url_producto", chosen, details, latest, [term, *order_by], fields, folder)


def enrich_postings(
    postings: DataFrame,
    details: DataFrame,
    order_by: Sequence[str] = ("term_no", "pos"),
    limit: int | None = None,
    parse: Parse | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Snippet, level and benefits from the details for the first `limit` postings overall (None: all).

    `details`: url, fetched_at, descripcion_completa, nivel_experiencia, beneficios_ofrecidos, or pages with `parse`.
    """
    fields = ("descripcion_breve", "nivel_experiencia", "beneficios_ofrecidos")
    values = (
        snippet(_unless(F.col("descripcion_completa"), fv.NOT_AVAILABLE)),
        _unless(F.col("nivel_experiencia"), fv.NOT_AVAILABLE),
        _unless(F.col("beneficios_ofrecidos"), fv.NOT_AVAILABLE),
    )

    def latest(found: DataFrame) -> DataFrame:
        found = latest_details((parse(found) if parse else found).where(F.col("url").startswith("http")))
        return found.select("url", *[value.alias(name) for name, value in zip(fields, values)])

    if limit is None:
        found = of_wanted(details, postings, "url_empleo") if parse else details
        return _update_all(postings, "url_empleo", latest(found), order_by, fields)
    chosen = chosen_postings(postings, order_by, limit)
    return _update_chosen(postings, "url_empleo", chosen, details, latest, list(order_by), fields, folder)
