"""Records from stored HTML pages.

`extract_records` is the one place with Python on the executors: it parses each page once, in Arrow batches, inside the scan
stage (no shuffle), and returns the raw candidates of every field. All decisions - which candidate wins, defaults, urls,
validation - are Columns after it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from vitrina import fixed_values as fv
from vitrina.functions import labels
from vitrina.functions.dates import as_of_column
from vitrina.functions.text import (
    absolute_listing_url, absolute_posting_url, has_any, snippet, strip,
)
from vitrina.operators.html import Document


@dataclass(frozen=True)
class Field:
    """Candidates of one field, in selector order: text or an attribute of the first match (or of all matches).

    With `near_link`, the candidate is the href of the nearest link around the match, else of the first such link in the
    block; it then has one entry per match, possibly NULL, so that it lines up with a text field of the same selectors.
    """

    name: str
    selectors: tuple[str, ...]
    attribute: str | None = None
    every: bool = False
    near_link: str | None = None


@dataclass(frozen=True)
class Spec:
    """What to extract. Without containers the whole page is the one block.

    `limit` blocks are taken per container selector; `first_only` stops at the first selector that finds any. If none
    does, the nearest `li` around each of the first `limit` links `fallback_link` is a block.

    With `block_words`, only blocks with one of them and more than `block_chars` characters count, and fields are looked up only
    in those of the first selector that has any, at most `cards` of them. `page_text` adds the text of the body of pages without
    any block, NULL for others. Without `content` the text of the blocks is left out of the result (NULL): it is most of what would
    cross from Python.
    """

    fields: tuple[Field, ...]
    containers: tuple[str, ...] = ()
    limit: int | None = None
    first_only: bool = True
    fallback_link: str | None = None
    block_words: tuple[str, ...] = ()
    block_chars: int = 0
    cards: int | None = None
    page_text: bool = False
    content: bool = True


def _blocks(page: Document, spec: Spec) -> Iterator[tuple[int, int, int]]:
    if not spec.containers:
        yield 0, 1, 0
        return
    found = False
    for number, selector in enumerate(spec.containers):
        for place, index in enumerate(page.select(0, selector), 1):
            if spec.limit is not None and place > spec.limit:
                break
            found = True
            yield number, place, index
        if found and spec.first_only:
            return
    if not found and spec.fallback_link:
        links = list(page.select(0, spec.fallback_link))[:spec.limit]
        items = [item for item in (page.ancestor(link, "li") for link in links) if item]
        for place, index in enumerate(items, 1):
            yield len(spec.containers), place, index


def _usable(page: Document, spec: Spec) -> Iterator[tuple[int, int, int, str | None]]:
    """Blocks with their text, if asked for; with `block_words`, the usable ones of the first selector that has any."""
    chosen, taken = None, 0
    for number, place, index in _blocks(page, spec):
        if chosen is not None and (number != chosen or taken == spec.cards):
            return
        content = page.text_content(index) if spec.content or spec.block_words else None
        if spec.block_words:
            lower = content.lower()
            if len(content.strip(fv.WHITESPACE)) <= spec.block_chars or not any(word in lower for word in spec.block_words):
                continue
            chosen, taken = number, taken + 1
        yield number, place, index, content if spec.content else None


def _candidates(page: Document, block: int, field: Field, searches: list[tuple]) -> list[str | None]:
    values: list[str | None] = []
    for found, tops in searches:
        for index in page.part(block, found, tops, field.every):
            if field.near_link:
                link = page.ancestor(index, "a") or page.first(block, field.near_link)
                values.append(page.attributes(link).get("href") if link else None)
            elif field.attribute:
                values.append(page.attributes(index).get(field.attribute))
            else:
                values.append(page.inner_text(index))
    return values


def _parse_pages(htmls: pa.Array, spec: Spec) -> tuple[pa.Array, pa.Array]:
    """Blocks and page text of every page. The values are gathered by column, so that Arrow takes flat lists."""
    sels, places, contents, page_texts, ends = [], [], [], [], [0]
    columns = [(field, [], [0]) for field in spec.fields]
    for html in htmls.to_pylist():
        text = None if html is not None or not spec.page_text else ""
        if html is not None:
            page, searches = Document(html), None
            for number, place, index, content in _usable(page, spec):
                sels.append(number)
                places.append(place)
                contents.append(content)
                if searches is None:
                    searches = [page.searches(field.selectors) for field in spec.fields]
                for (field, values, stops), some in zip(columns, searches):
                    if some:
                        values += _candidates(page, index, field, some)
                    stops.append(len(values))
            if spec.page_text and len(sels) == ends[-1]:
                body = page.first(0, "body")
                text = "" if body is None else page.text_content(body)
        page_texts.append(text)
        ends.append(len(sels))
    arrays = [pa.array(sels, pa.int32()), pa.array(places, pa.int32()), pa.array(contents, pa.string())]
    for _, values, stops in columns:
        arrays.append(pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(values, pa.string())))
    names = ["sel", "pos", "content", *[field.name for field, _, _ in columns]]
    blocks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, names))
    return blocks, pa.array(page_texts, pa.string())


def extract_records(pages: DataFrame, spec: Spec) -> DataFrame:
    """Every page column but `html`, plus `blocks`: array of (sel, pos, content, one array of candidates per field).

    And `page_text`, if the spec asks for it.
    """
    kept = [name for name in pages.columns if name != "html"]
    names = [field.name for field in spec.fields]
    texts = ArrayType(StringType())
    block_type = StructType(
        [StructField("sel", IntegerType()), StructField("pos", IntegerType()), StructField("content", StringType())]
        + [StructField(name, texts) for name in names]
    )
    schema = StructType([pages.schema[name] for name in kept] + [StructField("blocks", ArrayType(block_type))])
    if spec.page_text:
        schema = schema.add("page_text", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Small output slices: the parsed blocks of a full batch are never held at once.
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                blocks, page_texts = _parse_pages(part.column("html"), spec)
                arrays = [part.column(name) for name in kept] + [blocks]
                if spec.page_text:
                    arrays.append(page_texts)
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return pages.select(*kept, "html").mapInArrow(run, schema)


def extract_containers(pages: DataFrame, containers: Sequence[str], limit: int | None = None) -> DataFrame:
    """Blocks of the first container selector that finds any: page columns, `pos`, raw `content`."""
    found = extract_records(pages, Spec((), tuple(containers), limit))
    kept = [name for name in found.columns if name != "blocks"]
    return found.select(*kept, F.explode("blocks").alias("b")).select(*kept, "b.pos", "b.content")


def is_listing_block(content: Column) -> Column:
    return (F.length(strip(content)) > fv.LISTING_BLOCK_CHARS) & has_any(F.lower(content), fv.LISTING_BLOCK_WORDS)


def first_text(candidates: Column, default: str | None = fv.MISSING) -> Column:
    """First candidate with visible text, trimmed."""
    shown = F.get(F.filter(F.transform(candidates, strip), lambda text: text != ""), F.lit(0))
    return shown if default is None else F.coalesce(shown, F.lit(default))


def first_match_text(pages: DataFrame, selectors: Sequence[str], default: str = fv.MISSING) -> DataFrame:
    """Per page, the text of the first selector with visible text."""
    found = extract_records(pages, Spec((Field("texts", tuple(selectors)),), content=False))
    return found.select("page_id", first_text(F.get("blocks", F.lit(0))["texts"], default).alias("text"))


def attribute_extract(
    pages: DataFrame, selector: str, attribute: str, default: str = fv.MISSING
) -> DataFrame:
    """Per page, an attribute of the first match, trimmed."""
    found = extract_records(pages, Spec((Field("values", (selector,), attribute),), content=False))
    return found.select("page_id", first_text(F.get("blocks", F.lit(0))["values"], default).alias("value"))


def presence_flag(pages: DataFrame, selectors: Sequence[str]) -> DataFrame:
    """Per page, `Sí` when any selector matches, else `No`."""
    found = extract_records(pages, Spec((Field("texts", tuple(selectors)),), content=False))
    hit = F.size(F.get("blocks", F.lit(0))["texts"]) > 0
    return found.select("page_id", yes_no(hit).alias("flag"))


def yes_no(flag: Column) -> Column:
    return F.when(flag, fv.YES).otherwise(fv.NO)


def image_url(sources: Column) -> Column:
    """Source of the first image, only if it is a full url."""
    source = F.get(sources, F.lit(0))
    return F.when(source.startswith("http"), source).otherwise(fv.MISSING)


def listing_url(hrefs: Column, host: str) -> Column:
    urls = F.filter(
        F.transform(hrefs, lambda href: absolute_listing_url(href, host)), lambda url: url.isNotNull()
    )
    return F.coalesce(F.get(urls, F.lit(0)), F.lit(fv.MISSING))


def _extraction_day(as_of: str | None) -> Column:
    return F.date_format(as_of_column(as_of), "yyyy-MM-dd")


LISTING_CARD = Spec(
    containers=fv.LISTING_CONTAINERS,
    first_only=False,
    block_words=fv.LISTING_BLOCK_WORDS,
    block_chars=fv.LISTING_BLOCK_CHARS,
    fields=(
        Field("titles", fv.LISTING_TITLES),
        Field("prices", fv.LISTING_PRICES),
        Field("hrefs", fv.LISTING_LINKS, "href"),
        Field("sellers", fv.LISTING_SELLERS),
        Field("shipping", fv.LISTING_SHIPPING),
        Field("images", ("img",), "src"),
    ),
)


def parse_valid_listing(title: Column, price: Column) -> Column:
    return (F.length(strip(title)) >= 5) & ~price.isin("", fv.MISSING)


def _watched(pages: DataFrame, spec: Spec, seen: Observation | None) -> DataFrame:
    """The records of pages; `seen` receives the number of pages and of those that look blocked or thin instead of holding records."""
    if seen is None:
        return extract_records(pages, spec)
    found = extract_records(pages, replace(spec, page_text=True))
    status = F.when(F.col("page_text").isNotNull(), labels.page_status(F.col("page_text")))
    counts = [F.count_if(status == name).alias(f"pages_{name}") for name in ("blocked", "thin")]
    return found.withColumn("status", status).observe(seen, F.count(F.lit(1)).alias("pages"), *counts).drop("page_text", "status")


def extract_listings(
    pages: DataFrame, host: str, as_of: str | None = None, max_cards: int | None = None, spec: Spec = LISTING_CARD,
    blocks_per_page: int | None = None, seen: Observation | None = None,
) -> DataFrame:
    """Listings on stored result pages (page_id, url, html, term), `pos` being the place of the card on its page.

    The container selector that counts is the first with a usable block among its first `blocks_per_page` blocks (None: all),
    and at most `max_cards` of its cards are taken (None: all). Both are decided while parsing: fields are looked up in the cards
    that are taken only. `seen` counts the pages, blocked and thin ones apart.
    """
    spec = replace(spec, cards=max_cards, content=False)
    if blocks_per_page is not None:
        spec = replace(spec, limit=blocks_per_page)
    found = _watched(pages, spec, seen)
    cards = found.select("page_id", "term", F.explode("blocks").alias("card")).select("page_id", "term", "card.*")
    price = first_text(F.col("prices"))
    rows = cards.select(
        "page_id",
        "pos",
        first_text(F.col("titles")).alias("producto"),
        F.when(price != fv.MISSING, F.concat(F.lit("$"), price)).otherwise(fv.MISSING).alias("precio"),
        first_text(F.col("sellers")).alias("vendedor"),
        F.lit("").alias("ubicacion"),
        F.lit("").alias("reputacion_vendedor"),
        _extraction_day(as_of).alias("fecha_extraccion"),
        listing_url(F.col("hrefs"), host).alias("url_producto"),
        F.lit(fv.YES).alias("disponible"),
        yes_no(F.size("shipping") > 0).alias("envio_gratis"),
        F.col("term").alias("categoria"),
        image_url(F.col("images")).alias("imagen_url"),
        F.lit("").alias("condicion"),
    )
    return rows.where(parse_valid_listing(F.col("producto"), F.col("precio")))


LISTING_DETAIL = Spec(
    fields=(
        Field("titles", fv.LISTING_DETAIL_TITLES),
        Field("prices", fv.LISTING_DETAIL_PRICES),
        Field("sellers", fv.LISTING_DETAIL_SELLERS),
        Field("places", fv.LISTING_DETAIL_PLACES),
        Field("reputations", fv.LISTING_DETAIL_REPUTATIONS),
        Field("conditions", fv.LISTING_DETAIL_CONDITIONS),
    )
)


def _detail_pages(pages: DataFrame, spec: Spec) -> DataFrame:
    found = extract_records(pages, replace(spec, content=False)).withColumn("b", F.get("blocks", F.lit(0)))
    return found.select(*[name for name in found.columns if name not in ("blocks", "b")], "b.*")


def listing_detail(pages: DataFrame) -> DataFrame:
    """One full detail record per stored listing page; pages without content are dropped."""
    found = _detail_pages(pages.where("html IS NOT NULL"), LISTING_DETAIL)

    def shown(name: str, default: str = fv.NOT_AVAILABLE) -> Column:
        text = first_text(F.col(name), None)
        return F.coalesce(F.when(text != fv.MISSING, text), F.lit(default))

    return found.select(
        F.coalesce("url", F.lit(fv.NOT_AVAILABLE)).alias("url"),
        shown("titles").alias("titulo"),
        shown("prices").alias("precio"),
        shown("sellers").alias("vendedor"),
        shown("places", fv.UNKNOWN_PLACE).alias("ubicacion"),
        shown("reputations", fv.UNKNOWN_PLACE).alias("reputacion"),
        shown("conditions").alias("condicion"),
    )


def listing_detail_updates(pages: DataFrame) -> DataFrame:
    """What `enrich_listings` needs from detail pages: url, fetched_at, ubicacion, reputacion_vendedor."""
    found = _detail_pages(pages.where("html IS NOT NULL"), LISTING_DETAIL)
    return found.select(
        "url",
        "fetched_at",
        first_text(F.col("places"), fv.UNKNOWN_PLACE).alias("ubicacion"),
        first_text(F.col("reputations"), fv.UNKNOWN_PLACE).alias("reputacion_vendedor"),
    )


def posting_card(max_cards: int | None) -> Spec:
    return Spec(
        containers=fv.POSTING_CONTAINERS,
        limit=max_cards,
        fallback_link=fv.POSTING_LINK,
        fields=(
            Field("titles", fv.POSTING_TITLES),
            Field("title_hrefs", fv.POSTING_TITLES, near_link=fv.POSTING_LINK),
            Field("companies", fv.POSTING_COMPANIES, every=True),
            Field("places", fv.POSTING_PLACES),
            Field("time_attr", fv.POSTING_TIME_ATTR, "datetime"),
            Field("time_text", fv.POSTING_TIME_TEXT),
            Field("snippets", fv.POSTING_SNIPPETS),
        ),
    )


def parse_valid_posting(title: Column, company: Column) -> Column:
    return ~title.isin("", fv.NOT_FOUND) & ~company.isin("", fv.NOT_FOUND)


def extract_postings(
    pages: DataFrame, host: str, as_of: str | None = None, max_cards: int | None = None, seen: Observation | None = None
) -> DataFrame:
    """Postings on stored result pages (page_id, url, html, term); `indice` = `pos` = place of the card on its page.

    `seen` counts the pages, blocked and thin ones apart.
    """
    found = _watched(pages, replace(posting_card(max_cards), content=False), seen)
    cards = found.select("page_id", "term", F.explode("blocks").alias("card")).select("page_id", "term", "card.*")
    title = F.get(
        F.filter(F.arrays_zip("titles", "title_hrefs"), lambda pair: strip(pair["titles"]) != ""), F.lit(0)
    )
    cards = cards.withColumns({"title": title, "place": labels.pick_location(F.col("places"))})
    not_found = F.lit(fv.NOT_FOUND)
    rows = cards.select(
        "page_id",
        "pos",
        "term",
        F.col("pos").alias("indice"),
        _extraction_day(as_of).alias("fecha_extraccion"),
        F.coalesce(strip(F.col("title.titles")), not_found).alias("titulo_puesto"),
        labels.pick_company(F.col("companies")).alias("empresa"),
        labels.location_text(F.col("place")).alias("ubicacion"),
        F.coalesce(absolute_posting_url(F.col("title.title_hrefs"), host), not_found).alias("url_empleo"),
        labels.location_mode(F.col("place")).alias("modalidad"),
        labels.pick_posting_date(F.col("time_attr"), F.col("time_text")).alias("fecha_publicacion"),
        F.coalesce(snippet(first_text(F.col("snippets"), None)), F.lit(fv.NOT_AVAILABLE)).alias("descripcion_breve"),
        F.lit(fv.NOT_AVAILABLE).alias("nivel_experiencia"),
        F.lit(fv.NOT_AVAILABLE).alias("beneficios_ofrecidos"),
    )
    return rows.where(parse_valid_posting(F.col("titulo_puesto"), F.col("empresa")))


POSTING_DETAIL = Spec(
    fields=(
        Field("descriptions", fv.POSTING_DETAIL_TEXTS),
        Field("levels", fv.POSTING_DETAIL_LEVELS, every=True),
        Field("benefits", fv.POSTING_DETAIL_BENEFITS),
    )
)


def posting_detail(pages: DataFrame) -> DataFrame:
    """Description, level and benefits per stored posting page (url, and fetched_at if the table has it)."""
    found = _detail_pages(pages.where("html IS NOT NULL"), POSTING_DETAIL)
    return found.select(
        *[name for name in ("url", "fetched_at") if name in found.columns],
        first_text(F.col("descriptions"), fv.NOT_AVAILABLE).alias("descripcion_completa"),
        labels.pick_level(F.col("levels")).alias("nivel_experiencia"),
        first_text(F.col("benefits"), fv.NOT_AVAILABLE).alias("beneficios_ofrecidos"),
    )


def page_statuses(pages: DataFrame) -> DataFrame:
    """`blocked`, `thin` or `ok` per stored page, from the text of its body."""
    body = extract_records(pages, Spec((), ("body",), 1))
    content = F.coalesce(F.get("blocks", F.lit(0))["content"], F.lit(""))
    return body.select("page_id", labels.page_status(content).alias("status"))
