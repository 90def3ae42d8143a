"""Ranks without bringing values together: places in a global order, the first rows of large groups, exact medians.

All three count before they move rows. Places come from rows per range partition and prefix sums of these counts. The first n rows
of a key and a median come from histograms that are refined until they name the boundary.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from vitrina.functions.images import INFINITE, double_image, from_image, order_images
from vitrina.sources.staging import stage_table

BINS = 4096
DIGIT = 16


def with_place(rows: DataFrame, order_by: Sequence, name: str = "place", folder: str | None = None) -> DataFrame:
    """Add the 0-based place of every row in the order `order_by`, in one range-partitioned shuffle.

    Rows are sorted in range partitions and staged with their number in the partition; the partitions' counts, one small number
    each, give the offsets. No task sees more than its range. Ties are settled by a hash of the whole row; equal rows are
    interchangeable, and stay in one range. The input is computed twice, the first time to sample the bounds.
    """
    tie = F.xxhash64(*rows.columns)
    sorted_rows = rows.repartitionByRange(*order_by, tie).sortWithinPartitions(*order_by, tie)
    number = F.monotonically_increasing_id().bitwiseAND(2**33 - 1)
    staged = stage_table(sorted_rows.withColumns({"__part": F.spark_partition_id(), "__number": number}), folder)
    counts = sorted(tuple(r) for r in staged.groupBy("__part").agg(F.max("__number") + 1).collect())  # one row a partition
    offsets, total = [], 0
    for part, count in counts:
        offsets.append((part, total))
        total += count
    offset = rows.sparkSession.createDataFrame(offsets, "__part int, __offset long")
    placed = staged.join(F.broadcast(offset), "__part")
    return placed.withColumn(name, F.col("__offset") + F.col("__number")).drop("__part", "__number", "__offset")


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def _before(images: Sequence[str], bounds: Sequence[str]) -> Column:
    """Whether the images, compared one after the other, are at most the bounds; an open bound is NULL."""
    found = F.lit(True)
    for image, bound in zip(reversed(images), reversed(bounds)):
        found = F.col(bound).isNull() | (F.col(image) < F.col(bound)) | ((F.col(image) == F.col(bound)) & found)
    return found


def first_bounds(rows: DataFrame, keys: Sequence[str], images: Sequence[str], n: int, spare: int) -> DataFrame | None:
    """For every key with more than n + spare rows, bounds of the images that at least n rows keep to, at most n + spare if it can be.

    One aggregate finds the large keys and the ranges of their images. Then, as long as a key keeps too many rows, one aggregate
    of BINS counts a key halves its range BINS-fold, or goes on to the next image where all rows left have the same. Each level is
    a staged table with one row per large key. None without large keys.
    """
    span = [F.struct(F.min(image).alias("low"), F.max(image).alias("high")).alias(f"__r{k}") for k, image in enumerate(images)]
    large = [f"__k{k}" for k in range(len(keys))]
    named = [F.col(key).alias(alias) for key, alias in zip(keys, large)]
    counted = rows.groupBy(*named).agg(F.count("*").alias("__n"), *span).where(F.col("__n") > n + spare)
    bounds = [f"__b{k}" for k in range(len(images))]
    ranges = F.array(*[F.col(f"__r{k}") for k in range(len(images))])
    # The first image that differs at all; those before it are bounds already.
    start = F.coalesce(*[F.when(F.col(f"__r{k}.low") < F.col(f"__r{k}.high"), k) for k in range(len(images))], F.lit(len(images) - 1))
    begun = counted.withColumn("__level", start).withColumn("__at", F.get(ranges, F.col("__level")))
    open_keys = stage_table(begun.select(
        *large, "__level", F.lit(n).cast("long").alias("__need"),
        *[F.when(F.col("__level") > k, F.col(f"__r{k}.low")).alias(bound) for k, bound in enumerate(bounds)], "__at.low", "__at.high",
    ))
    done: list[DataFrame] = []
    while not open_keys.isEmpty():
        at = F.array(*[F.col(image) for image in images])
        here = F.get(at, F.col("__level"))
        prefix = reduce(Column.__and__, [(F.col("__level") <= k) | (F.col(image) == F.col(bound)) for k, (image, bound) in enumerate(zip(images, bounds))])
        width = F.greatest(F.lit(1).cast("long"), F.expr(f"(high - low) div {BINS} + 1"))
        joined = rows.join(open_keys, _same(keys, large)).where(prefix & here.between(F.col("low"), F.col("high")))
        following = F.get(at, F.col("__level") + 1)
        binned = joined.groupBy(*large, "__level", "__need", *bounds, ((here - F.col("low")) / width).cast("long").alias("__bin")).agg(
            F.count("*").alias("__n"), F.min(here).alias("low"), F.max(here).alias("high"),
            F.min(following).alias("__low"), F.max(following).alias("__high"),
        )
        upto = F.sum("__n").over(W.partitionBy(*large).orderBy("__bin"))
        cut = binned.withColumn("__upto", upto).where("__upto >= __need AND __upto - __n < __need")
        cut = cut.withColumns({"__kept": F.col("__upto") - F.col("__need"), "__left": F.col("__need") - F.col("__upto") + F.col("__n")})
        single, last = F.col("low") == F.col("high"), F.col("__level") == len(images) - 1
        ended = (F.col("__kept") <= spare) | (single & last)
        step = ended | single
        level = stage_table(cut.select(
            *large, ended.alias("__ended"), F.when(single, F.col("__level") + 1).otherwise(F.col("__level")).alias("__level"),
            F.col("__left").alias("__need"),
            *[F.when((F.col("__level") == k) & step, F.col("high")).otherwise(F.col(bound)).alias(bound) for k, bound in enumerate(bounds)],
            F.when(single, F.col("__low")).otherwise(F.col("low")).alias("low"), F.when(single, F.col("__high")).otherwise(F.col("high")).alias("high"),
        ))
        done.append(level.where("__ended").select(*large, *bounds))
        open_keys = level.where("NOT __ended").drop("__ended")
    return reduce(DataFrame.unionByName, done) if done else None


def cut_to_first(rows: DataFrame, keys: Sequence[str], order_by: Sequence[str], n: int, spare: int | None = None) -> DataFrame:
    """Leave out rows that cannot be among the first n of their key; at most n + spare (default n) rows a key stay, and its ties."""
    spare = n if spare is None else spare
    columns: list[Column] = []
    for name in order_by:
        more, exact = order_images(rows, name)
        columns += more
        if not exact:  # behind a column with equal numbers for different values, later ones say nothing
            break
    images = [f"__i{k}" for k in range(len(columns))]
    imaged = rows.withColumns(dict(zip(images, columns)))
    bounds = first_bounds(imaged.select(*keys, *images), keys, images, n, spare)
    if bounds is None:
        return rows
    large = [name for name in bounds.columns if name.startswith("__k")]
    limits = [name for name in bounds.columns if name.startswith("__b")]
    kept = imaged.join(stage_table(bounds), _same(keys, large), "left").where(_before(images, limits))
    return kept.select(*rows.columns)


def _image(value: Column) -> Column:
    """The image of a double that is not NULL; declared so, lest a join on it repeat the whole expression in a null filter."""
    return F.coalesce(double_image(value), F.lit(0).cast("long"))


def top_digit(value: Column) -> Column:
    """The first of the four digits of a double's image."""
    return F.shiftright(_image(value), 64 - DIGIT)


def _chosen(counts: DataFrame, wanted: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """From counts (which, prefix, n): for each of the wanted (prefix, rank), the prefix that holds its rank, and the rank in it."""
    ranks = F.element_at(F.array(*[F.lit(rank) for _, rank in wanted]), F.col("which") + 1)
    upto = F.sum("n").over(W.partitionBy("which").orderBy("prefix"))
    found = counts.withColumns({"upto": upto, "rank": ranks}).where("upto >= rank AND upto - n < rank")
    rows = found.select("which", "prefix", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")).collect()  # two rows
    return [(row.prefix, row.rank) for row in sorted(rows)]


def exact_median(rows: DataFrame, value: Column, top_counts: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """One row `median`: the exact median of a double column; NULL is left out, NaN is the largest value.

    `top_counts` (prefix, n) are the rows per `top_digit`, where a pass over the rows has counted them already. They name the one
    or two digits that hold the middle ranks. A second pass counts the different values between the bounds of these digits, spread
    over tasks by value, and stages the counts; three more digits are chosen from them. One task sees at most 2^16 counts for each
    of the two ranks, and the driver two numbers a digit.
    """
    spark = rows.sparkSession
    known = rows.select(value.alias("value")).where("value IS NOT NULL")
    if top_counts is None:
        top_counts = known.groupBy(top_digit(F.col("value")).alias("prefix")).agg(F.count("*").alias("n"))
    top_counts = stage_table(top_counts, folder)
    total = top_counts.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([(None,)], "median double")
    both = F.explode(F.array(F.lit(0), F.lit(1))).alias("which")
    wanted = _chosen(top_counts.select(both, "prefix", "n"), [(0, (total + 1) // 2), (0, total // 2 + 1)])
    within = F.lit(False)
    for digit in {digit for digit, _ in wanted}:
        low, high = digit << (64 - DIGIT), ((digit + 1) << (64 - DIGIT)) - 1
        upper = F.lit(True) if high > INFINITE else F.col("value") <= F.lit(from_image(high))
        within = within | ((F.col("value") >= F.lit(from_image(low))) & upper)
    counts = stage_table(known.where(within).groupBy("value").agg(F.count("*").alias("n")), folder)
    counts = counts.withColumn("image", _image(F.col("value")))
    for shift in (2 * DIGIT, DIGIT, 0):
        here = [F.shiftright("image", shift + DIGIT) == F.lit(prefix) for prefix, _ in wanted]
        which = F.explode(F.filter(F.array(*[F.when(match, k) for k, match in enumerate(here)]), F.isnotnull)).alias("which")
        digits = counts.select(which, F.shiftright("image", shift).alias("prefix"), "n").groupBy("which", "prefix").agg(F.sum("n").alias("n"))
        wanted = _chosen(digits, wanted)
    first, second = (from_image(image) for image, _ in wanted)
    return spark.createDataFrame([((first + second) / 2.0,)], "median double")
