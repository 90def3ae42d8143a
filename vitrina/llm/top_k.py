"""Exact top-k inner products by distributed histogram selection.

Queries and candidates meet in cells (a slice of candidates, a block of queries), both of bounded size, and every cell scores
all its pairs as matrix products. A round sends, for each query, counts of the scores by bin of the range that is still open;
summed over all cells they show which bin holds the kth value, and that bin is the range of the next round, until it is one
value wide. The last pass sends the scores above the kth value and, of those equal to it, no more than k smallest ids a cell.

Bins below a cell's own kth value are not sent: the kth value of all rows cannot lie below it.

Defined cases: vectors that are NULL, or hold NULL or non-finite components, and rows without id take no part; vectors meet
those of their own length only; an id on several rows is as many candidates and queries, and none of them is a candidate of the
others; ties go to the smaller id; a query with fewer than k candidates returns them all; no rows, no result. Scores beyond a long are refused with an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vitrina.sources.staging import stage_table

SCALE = 64
BINS = 256
QUERY_BLOCK = 2048
SLICE = 1024
QUERIES_AT_ONCE = 256


def whole_numbers(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * component) of every component; NULL for vectors that take no part."""
    value = F.transform(embedding, lambda x: x.cast("double"))
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(value, lambda x: F.floor(x * F.lit(float(scale)))))


def _matrix(table: pa.Table, name: str, dim: int) -> np.ndarray:
    flat = table.column(name).combine_chunks()
    flat = (flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(table.num_rows, dim)


def _blocks(table: pa.Table, exact: bool):
    """Queries of a cell in blocks: their rows and the scores against all candidates (own row masked out)."""
    queries = table.filter(table.column("is_query"))
    candidates = table.filter(pa.compute.invert(table.column("is_query")))
    if not queries.num_rows or not candidates.num_rows:
        return
    dim = table.column("dim")[0].as_py()
    kind = np.float64 if exact else np.int64  # doubles hold every sum exactly as long as the bound says so
    q, c = _matrix(queries, "v", dim).astype(kind), _matrix(candidates, "v", dim).astype(kind)
    ids = candidates.column("vec_id").to_numpy()
    for start in range(0, len(q), QUERIES_AT_ONCE):
        part = queries.slice(start, QUERIES_AT_ONCE)
        own = part.column("vec_id").to_numpy()
        yield part, ids, (q[start : start + QUERIES_AT_ONCE] @ c.T).astype(np.int64), own[:, None] == ids[None, :]


def _histogram(exact: bool):
    def run(table: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] for _ in range(3)]
        for part, _, score, own in _blocks(table, exact):
            low, width, span, need = (part.column(n).to_numpy()[:, None] for n in ("low", "width", "span", "need"))
            at = (score - low) // width
            inside = (score >= low) & (score < low + span) & ~own
            row = np.arange(len(score))[:, None] * BINS
            counts = np.bincount((row + at)[inside], minlength=len(score) * BINS).reshape(len(score), BINS)
            above = counts[:, ::-1].cumsum(1)[:, ::-1] - counts  # in higher bins of this range
            r, b = np.nonzero((counts > 0) & (above < need))  # a cell's lower bins cannot hold the kth value of all
            for column, values in zip(out, (part.column("row").to_numpy()[r], b, counts[r, b])):
                column.append(values)
        return pa.table(dict(zip(("row", "bin", "n"), (pa.array(np.concatenate(c), pa.int64()) for c in out))))

    return run


def _chosen(exact: bool, k: int):
    def run(table: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] for _ in range(4)]
        for part, ids, score, own in _blocks(table, exact):
            low = part.column("low").to_numpy()[:, None]
            order = np.argsort(ids, kind="stable")
            score, own, sorted_ids = score[:, order], own[:, order], ids[order]
            level = (score == low) & ~own
            level &= level.cumsum(1) <= k
            r, c = np.nonzero(((score > low) & ~own) | level)
            for column, values in zip(out, (part.column("row").to_numpy()[r], part.column("vec_id").to_numpy()[r], sorted_ids[c], score[r, c])):
                column.append(values)
        return pa.table(dict(zip(("row", "query_id", "vec_id", "score"), (pa.array(np.concatenate(c), pa.int64()) for c in out))))

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = SCALE, slice_rows: int = SLICE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest integer inner products of every query with all other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding"), scale).alias("v"), is_query.alias("is_query"))
    rows = rows.where("vec_id IS NOT NULL AND v IS NOT NULL").withColumns({"dim": F.size("v"), "row": F.monotonically_increasing_id()})
    rows = stage_table(rows)  # from here on a row keeps its number
    facts = rows.agg(
        F.count("*").alias("n"), F.count_if("is_query").alias("queries"),
        F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("square"),
    ).first()
    if not facts.queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bound = math.ceil(facts.square * (1 + 1e-9)) + 1  # of any score, by Cauchy and Schwarz
    if bound >= 2**62:
        raise OverflowError("scores would exceed a long")
    exact = bound < 2**52
    slices, blocks = -(-facts.n // slice_rows), -(-facts.queries // query_block)
    place = F.xxhash64("row")
    candidates = rows.select(
        "row", "vec_id", "v", "dim", F.lit(False).alias("is_query"), F.pmod(place, F.lit(slices)).cast("int").alias("slice"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        *[F.lit(0).cast("long").alias(n) for n in ("low", "width", "span", "need")],
    )

    def cells(ranges: DataFrame) -> DataFrame:
        asked = ranges.select(
            "row", "vec_id", "v", "dim", F.lit(True).alias("is_query"),
            F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
            F.pmod(place, F.lit(blocks)).cast("int").alias("block"), "low", "width", "span", "need",
        )
        return candidates.unionByName(asked).groupBy("slice", "block", "dim")

    width = -(-(2 * bound + 1) // BINS)
    ranges = rows.where("is_query").select(
        "row", "vec_id", "v", "dim", F.lit(-bound).cast("long").alias("low"), F.lit(width).cast("long").alias("width"),
        F.lit(2 * bound + 1).cast("long").alias("span"), F.lit(k).cast("long").alias("need"),
    )
    while True:
        counts = cells(ranges).applyInArrow(_histogram(exact), "row long, bin long, n long")
        counts = counts.groupBy("row", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("row").orderBy(F.col("bin").desc())
        counts = counts.withColumn("reached", F.sum("n").over(down)).select("row", "bin", "n", "reached")
        # The first bin at which the count reaches what is needed, or the lowest filled one if all are too few.
        cut = (
            counts.join(ranges.select("row", "need"), "row").where(F.col("reached") - F.col("n") < F.col("need"))
            .groupBy("row").agg(F.min_by(F.struct("bin", "n", "reached"), F.col("bin")).alias("cut"))
        )
        step = -(-width // BINS)
        ranges = stage_table(
            ranges.join(cut, "row").select(
                "row", "vec_id", "v", "dim", (F.col("low") + F.col("cut.bin") * F.col("width")).alias("low"), F.lit(step).cast("long").alias("width"), F.col("width").alias("span"),
                F.least(F.col("need") - F.col("cut.reached") + F.col("cut.n"), F.col("cut.n")).alias("need"),
            )
        )
        if width == 1:
            break
        width = step
    found = cells(ranges).applyInArrow(_chosen(exact, k), "row long, query_id long, vec_id long, score long")
    best = W.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
