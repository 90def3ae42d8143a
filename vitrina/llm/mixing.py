"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every source gets a target in words: its share of a budget by weight, but never more than `most` times its own words; what is
above that goes to the other sources by weight until none is above. The rate target / words is what every document of the source
expects as its number of copies. Expected copies are summed up along the source, one random offset is added, and a document is
taken once for every integer that the sum crosses at it: the whole part of its rate, or one more.

Documents stand in the order of their size class (largest first, 32 classes per power of two), then of a hash of id and text, so
that every stretch of the sum meets documents of like size, and the words taken differ from the target by about the largest
document. That order does not depend on how the work is cut. Places in it come from counts: rows per class, classes above a
bounded number of rows cut in ranges of the hash, prefix sums of the counts (classes of a source, then cells of a class), and a running sum in each cell. Sums
are whole numbers of 2^-28 copies, so no rounding depends on the number of rows.

Scale: texts are read once; the narrow rows (id, source, size, hash) are staged and shuffled twice. Equal narrow rows are combined
before the first shuffle, so a hot source, size, id or repeated row splits like any other. What is joined back has one row per
cell. Only sources (one row each, as many as there are weights to give) are ordered in one task.

Defined cases: NULL text has size 0; NULL source is a source of its own, after all others; NULL ids are hashed as one space; rows
that are equal are taken one by one; a source without words has target 0 and is not taken; very long texts are read whole; an empty
table gives an empty result. Only id, text and source are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrina.sources.staging import stage_table

BITS = 28
ROWS_PER_CELL = 2_000
SEED = 42


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blanks; memory follows the text, not the number of words."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "x")
    return F.length(F.regexp_replace(marked, r"[\x20\x09-\x0D]++", "")).cast("long")


def source_key(source: Column) -> Column:
    """The source as a key that is never NULL."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def draw(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A hash of id and text from 0 to 2^32 - 1."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 8), 16, 10).cast("long")


def size_class(size: str) -> Column:
    """Monotone class of a whole number: itself up to 63, then 32 classes per power of two."""
    return F.expr(
        f"greatest(length(bin({size})) - 6, 0) * 32 + shiftright({size}, greatest(length(bin({size})) - 6, 0))"
    ).cast("int")


def targets(totals: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """`target` of every row of totals (source, source_size): one row per source.

    Sources by code point, NULL last, weigh `weights`, repeating. With the sources in the order in which they reach their limit, the
    level of k uncapped sources is what the capped ones leave over the weights of the rest; the true level is the highest of them.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = totals.withColumn("__weight", F.element_at(cycle, (number % len(weights) + 1).cast("int"))).withColumn(
        "__limit", F.lit(float(most)) * F.col("source_size")
    )
    full_first = Window.orderBy(F.col("__limit") / F.col("__weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    total = F.sum(F.col("source_size")).over(everything) * F.lit(float(budget))
    capped = F.sum("__limit").over(full_first.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__limit")
    left = F.sum("__weight").over(full_first.rowsBetween(0, Window.unboundedFollowing))
    leveled = weighed.withColumn("__level", (total - capped) / left)
    level = F.max("__level").over(everything)
    target = F.least(F.col("__limit"), F.greatest(F.lit(0.0), level * F.col("__weight")))
    return leveled.withColumn("target", target).drop("__weight", "__limit", "__level")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, draw, size, source_size, target and `copies`, how often the mix takes it."""
    key, cell = source_key(F.col("source")), ["__key", "__class", "__slice"]
    narrow = docs.select(
        "doc_id", "source", draw(F.col("doc_id"), F.col("text"), seed).alias("draw"), word_count(F.col("text")).alias("size")
    )
    rows = stage_table(narrow.groupBy("doc_id", "source", "draw", "size").agg(F.count("*").alias("__n")))
    rows = rows.withColumns({"__key": key, "__class": size_class("size")})
    classes = stage_table(
        rows.groupBy("__key", "__class").agg(F.first("source").alias("source"), F.sum("__n").alias("__rows"),
                                             F.sum(F.col("size") * F.col("__n")).alias("__words"))
    )
    sources = targets(
        classes.groupBy("__key").agg(F.first("source").alias("source"), F.sum("__words").alias("source_size")), weights, budget, most
    )
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * 2**BITS)).otherwise(0).cast("long")
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("__key")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")
    larger = Window.partitionBy("__key").orderBy(F.col("__class").desc())
    planned = stage_table(
        classes.drop("source", "__words")
        .withColumn("__larger", F.sum("__rows").over(larger) - F.col("__rows"))
        .join(sources.drop("source").withColumns({"__rate": rate, "__start": start}), "__key")
        .withColumn("__slices", F.expr(f"1 + __rows div {ROWS_PER_CELL}"))
        .drop("__rows")
    )
    sliced = rows.join(planned, ["__key", "__class"]).withColumn("__slice", F.expr("shiftright(draw * __slices, 32)"))
    in_order = Window.partitionBy("__key", "__class").orderBy("__slice")
    cells = sliced.groupBy(*cell).agg(F.sum("__n").alias("__in_cell"), F.first("__larger").alias("__larger"))
    before = F.col("__larger") + F.sum("__in_cell").over(in_order) - F.col("__in_cell")
    cells = cells.select(*cell, before.alias("__before"))
    upto = F.sum("__n").over(Window.partitionBy(*cell).orderBy("draw", "doc_id", "size"))
    placed = sliced.withColumn("__upto", upto - F.col("__n")).join(cells, cell)
    single = placed.select(
        "doc_id", "source", "draw", "size", "source_size", "target", "__rate", "__start",
        F.explode(F.sequence(F.col("__before") + F.col("__upto"), F.col("__before") + F.col("__upto") + F.col("__n") - 1)).alias("__place"),
    )
    # Only the part of the sum below one copy decides, so the place may be taken modulo 2^BITS.
    part = (F.col("__place") % 2**BITS * F.col("__rate") + F.col("__start")) % 2**BITS
    copies = F.shiftright(part + F.col("__rate"), BITS)
    return single.select("doc_id", "source", "draw", "size", "source_size", "target", copies.alias("copies"))


def emit(docs: DataFrame, mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed corpus: every document of `docs` as often as `mixed` takes it, with `copy` from 1 on. One shuffle of the texts."""
    names = ["doc_id", "source", "draw"]
    keyed = docs.withColumn("__key", F.struct(
        F.coalesce(F.col("doc_id").cast("string"), F.lit(" ")), source_key(F.col("source")), draw(F.col("doc_id"), F.col("text"), seed)
    ))
    taken = mixed.where("copies > 0").groupBy(*names).agg(F.sum("copies").alias("__copies"))
    taken = taken.select("__copies", F.struct(
        F.coalesce(F.col("doc_id").cast("string"), F.lit(" ")), source_key(F.col("source")), F.col("draw")
    ).alias("__key"))
    found = keyed.dropDuplicates(["__key"]).join(taken, "__key")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).drop("__key", "__copies")
