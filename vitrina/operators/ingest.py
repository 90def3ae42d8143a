"""Union of search terms, per-term caps and keep-first deduplication.

Order matters in all three, so each takes `order_by`: columns that number the rows of one term without ties, for example
`("term_no", "pos")`. No operator here builds a global row number: a keep-first filter plans to a map-side group limit
below the shuffle, so a key that holds a third of all rows crosses the network as a few rows per map task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from vitrina import fixed_values as fv
from vitrina.functions.text import canonical_url
from vitrina.operators import known_keys
from vitrina.operators.ranks import cut_to_first
from vitrina.sources.staging import stage_table

# Above this limit Spark does not cut groups before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
_MAP_SIDE_LIMIT = 1000
_RANK = "__rank"


def union_terms(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of all terms in term order, duplicates kept, tagged with `term_no`.

    For terms that already share one table use `number_terms`: one scan instead of one per term.
    """
    tagged = [frame.withColumn("term_no", F.lit(no)) for no, frame in enumerate(frames.values())]
    return reduce(DataFrame.unionByName, tagged)


def number_terms(rows: DataFrame, term: str, terms: Sequence[str], dropped: Observation | None = None) -> DataFrame:
    """Keep the rows of the given terms and tag them with their place in the list; `dropped` receives the count of the others."""
    number = F
    for no, name in enumerate(terms):
        number = number.when(F.col(term) == name, no)
    listed = F.coalesce(F.col(term).isin(*terms), F.lit(False))
    if dropped is not None:
        rows = rows.observe(dropped, F.count_if(~listed).alias("rows_other_terms"))
    return rows.where(listed).withColumn("term_no", number.otherwise(None))


def first_rows(rows: DataFrame, keys: Sequence[str], order_by: Sequence, n: int | None = 1) -> DataFrame:
    """The first `n` rows of every key (None: all). Exact for any `n` and for hot keys.

    Above 1000 rows a key, where Spark does not cut groups before the shuffle, `order_by` must be column names: histograms of them
    say first which rows can be among the first n, so that no more than about 2 n rows a key are shuffled and ranked.
    """
    if n is None:
        return rows
    if n > _MAP_SIDE_LIMIT:
        if not all(isinstance(name, str) for name in order_by):
            raise TypeError("more than 1000 rows a key need an order by column names")
        rows = cut_to_first(rows, keys, order_by, n)
    window = Window.partitionBy(*keys).orderBy(*order_by)
    return rows.withColumn(_RANK, F.row_number().over(window)).where(F.col(_RANK) <= n).drop(_RANK)


def cap_per_term(
    rows: DataFrame, term: str = "categoria", order_by: Sequence[str] = ("pos",), n: int | None = None
) -> DataFrame:
    """The first `n` rows of every term; all of them without `n`."""
    return first_rows(rows, [term], order_by, n)


def _printed(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("None"))


def _row_key(url: str, unset: str, fallback: Sequence[str], canonical: bool) -> Column:
    link = F.col(url)
    known = link.isNull() | (link != unset)
    return F.when(known, canonical_url(link) if canonical else link).otherwise(
        F.concat_ws("_", *[_printed(name) for name in fallback])
    )


def listing_key(canonical: bool = False) -> Column:
    """What makes listings equal: the url, or title, price and seller where there is none."""
    return _row_key("url_producto", fv.MISSING, ("producto", "precio", "vendedor"), canonical)


def posting_key(canonical: bool = False) -> Column:
    """What makes postings equal: the url, or title and company where there is none."""
    return _row_key("url_empleo", fv.NOT_FOUND, ("titulo_puesto", "empresa"), canonical)


def _keep_first(rows: DataFrame, key: Column, order_by) -> DataFrame:
    return first_rows(rows.withColumn("__key", key), ["__key"], order_by).drop("__key")


def dedup_listings(
    listings: DataFrame, order_by: Sequence[str] = ("term_no", "pos"), canonical: bool = False
) -> DataFrame:
    """First listing per url; listings without url count as equal when title, price and seller are equal."""
    return _keep_first(listings, listing_key(canonical), order_by)


def dedup_postings(
    postings: DataFrame, order_by: Sequence[str] = ("term_no", "pos"), canonical: bool = False
) -> DataFrame:
    """First posting per url; postings without url count as equal when title and company are equal."""
    return _keep_first(postings, posting_key(canonical), order_by)


def _incremental(rows: DataFrame, key: Column, order_by, index: str) -> DataFrame:
    new = stage_table(known_keys.unseen(_keep_first(rows, key, order_by), key, index))
    known_keys.add_keys(new.select(known_keys.key_text(key).alias("key")), index)
    return new


def dedup_listings_incremental(
    listings: DataFrame, index: str, order_by: Sequence[str] = ("term_no", "pos"), canonical: bool = False
) -> DataFrame:
    """`dedup_listings` of a snapshot, without what earlier snapshots had; its keys are added to the index, a folder.

    The results for snapshots one after the other are together those of one deduplication of all of them, earlier ones first.
    A repeated run of the same snapshot returns nothing; see `known_keys` for what is read and shuffled.
    """
    return _incremental(listings, listing_key(canonical), order_by, index)


def dedup_postings_incremental(
    postings: DataFrame, index: str, order_by: Sequence[str] = ("term_no", "pos"), canonical: bool = False
) -> DataFrame:
    """Same for postings."""
    return _incremental(postings, posting_key(canonical), order_by, index)


def valid_listing(title: Column, price: Column) -> Column:
    return (
        ~title.isin("", fv.NOT_AVAILABLE) & ~price.isin("", fv.NO_PRICE) & (F.length(title) >= 5)
    )


def valid_posting(title: Column, company: Column) -> Column:
    return (
        ~title.isin("", fv.NOT_AVAILABLE) & (F.length(title) >= 3) & ~company.isin("", fv.NOT_AVAILABLE)
    )
