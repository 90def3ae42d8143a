"""Schemas of the two snapshot kinds; every snapshot column is read as text."""

from pyspark.sql.types import StringType, StructField, StructType

from vitrina.fixed_values import LISTING_COLUMNS, POSTING_COLUMNS


def _text_schema(names) -> StructType:
    return StructType([StructField(name, StringType()) for name in names])


LISTING_SCHEMA = _text_schema(LISTING_COLUMNS)
POSTING_SCHEMA = _text_schema(POSTING_COLUMNS)
