"""Helpers of the corpus operators: Arrow batches of rows, word lists, row keys."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

ROWS_AT_ONCE = 256
SPARE = 1.25
WORD = re.compile(r"\w+")


def map_rows(
    rows: DataFrame, function: Callable[[pa.RecordBatch], dict], columns: str, keep: Sequence[str] = (), at_once: int = ROWS_AT_ONCE
) -> DataFrame:
    """Add columns that `function` computes from slices of at most `at_once` rows; only `keep` of the input stays.

    `function` gets a record batch and returns the new columns by name, one value a row. Nothing outlives a slice, so the
    memory of a task depends on the slice alone.
    """
    new = rows.sparkSession.createDataFrame([], columns).schema
    schema = rows.select(*keep).schema
    for field in new:
        schema = schema.add(field)
    types = {f.name: f.dataType for f in new}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                got = function(part)
                arrays = [part.column(name) for name in keep]
                arrays += [pa.array(got[name], to_arrow_type(kind)) for name, kind in types.items()]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, *types])

    return rows.mapInArrow(run, schema)


def flat_map_rows(
    rows: DataFrame, function: Callable[[pa.RecordBatch], dict], columns: str, at_once: int = ROWS_AT_ONCE
) -> DataFrame:
    """Like `map_rows`, but any number of rows comes out of a slice, and nothing of the input is kept."""
    schema = rows.sparkSession.createDataFrame([], columns).schema
    types = {f.name: f.dataType for f in schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                got = function(batch.slice(start, at_once))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got[name], to_arrow_type(kind)) for name, kind in types.items()], list(types)
                )

    return rows.mapInArrow(run, schema)


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return WORD.findall(text.lower()) if text else []


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def held_out(doc_id: Column, modulus: int, value: int) -> Column:
    """Whether a row is kept from training; rows without id are not held out, and never train either (see callers)."""
    return F.coalesce(remainder(doc_id, modulus) == value, F.lit(False))


def low_draws(draw: Column, sample: int, total: Column | int) -> Column:
    """Whether a 64-bit hash lies in the lowest range of hashes that holds about SPARE times `sample` of `total` rows.

    Hashes are spread evenly, so this cuts a bounded sample out in the scan: no later sort or task meets more than that.
    """
    share = F.lit(SPARE * sample) / F.greatest(F.lit(total) if isinstance(total, int) else total, F.lit(1))
    return draw.cast("double") <= F.lit(-(2.0**63)) + share * F.lit(2.0**64)


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
