"""Bloom filters of fixed size as small tables, in DataFrame functions: what is surely not in a set of keys, before any shuffle.

A filter has `chunks` bitmaps of 32,768 bits (4 kB each); a key sets BITS bits in the one that its hash names. It is built by one
aggregate with at most `chunks` rows, bitmaps of several sets are combined bit by bit, and it is looked up by one broadcast join of
a size that does not depend on the data. A NULL key is in no set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CHUNKS = 1024
BITS = 4
_BITMAP = 32_768


def _chunk(key: Column, chunks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(chunks)).cast("int")


def _bit(key: Column, number: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(number)), F.lit(_BITMAP))


def bitmaps(keys: DataFrame, key: str = "key", chunks: int = CHUNKS) -> DataFrame:
    """The filter of a column: chunk, bits."""
    bits = F.explode(F.array(*[_bit(F.col(key), number) for number in range(BITS)])).alias("bit")
    known = keys.where(F.col(key).isNotNull()).select(_chunk(F.col(key), chunks).alias("chunk"), bits)
    return known.groupBy("chunk").agg(F.bitmap_construct_agg("bit").alias("bits"))


def combined(filters: DataFrame) -> DataFrame:
    """Bitmaps of several sets of keys, made with the same number of chunks, as the filter of all of them."""
    return filters.groupBy("chunk").agg(F.bitmap_or_agg("bits").alias("bits"))


def with_maybe(rows: DataFrame, key: Column, filter_: DataFrame, name: str, chunks: int = CHUNKS) -> DataFrame:
    """Add the flag `name`: false only where the key is surely not in the set of the filter."""
    small = F.broadcast(filter_.select(F.col("chunk").alias("__chunk"), F.col("bits").alias("__bits")))
    probed = rows.withColumn("__probe", key).withColumn("__chunk", F.coalesce(_chunk(F.col("__probe"), chunks), F.lit(-1)))
    probed = probed.join(small, "__chunk", "left")

    def holds(number: int) -> Column:
        at = _bit(F.col("__probe"), number)
        byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0

    maybe = F.col("__probe").isNotNull()
    for number in range(BITS):
        maybe = maybe & F.coalesce(holds(number), F.lit(False))
    return probed.withColumn(name, maybe).drop("__probe", "__chunk", "__bits")
