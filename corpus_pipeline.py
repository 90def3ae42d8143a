"""The corpus pipeline: documents without toxic texts, near copies and benchmark leaks, pseudonymised and encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrina.llm import decontamination, near_copies, pii, piece_codec, toxicity
from vitrina.llm.common import documents, remainder
from vitrina.llm.queries import PII_KEY, piece_model
from vitrina.sources.staging import stage_table


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scorer = toxicity.train(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    scored = toxicity.score_documents(docs, scorer, docs.columns, ("__score", "__toxic"))
    return scored.where(F.col("__toxic") == 0).drop("__score", "__toxic")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one document stays, the one with the smallest id."""
    return near_copies.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one, go."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms; n_chars follows the text."""
    changed = pii.pseudonymise(docs, PII_KEY, count_name="__private").withColumn("n_chars", F.length("text").cast("long"))
    return changed.select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the piece ids of every document, and the digest of the text decoded from them."""
    return piece_codec.encode_and_decode(docs, piece_model())


STAGES = [
    ("toxicity", toxic_texts),
    ("near_copies", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("pii", private_values),
    ("pieces", pieces),
]
ORACLE_SQL = None  # trained models, alignment and merges are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again before the next stage."""
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = stage_table(docs)
    return docs
