"""Registered queries of the corpus operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrina.llm import (
    decontamination, fill_in_middle, mixing, near_copies, pii, piece_codec, secret_scan, string_kernel, top_k, toxicity, turn_repair,
    url_filter, warc,
)
from vitrina.llm.common import documents, held_out, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def piece_model() -> bytes:
    """The public vocabulary file; its place is the only thing taken from the package that holds it."""
    import public_tokenizers

    return Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


PII_KEY = "vitrina-demo-key"  # production keys come from the caller


@query
def op1_pii(spark, sf_dir):
    return pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), PII_KEY)


@query
def op2_revisits(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op3_near_copies(spark, sf_dir):
    found = near_copies.near_copies(documents(spark, sf_dir))
    return found.select("doc_id", "class_id", "n_links", "n_similar_texts")


@query
def op4_top_k(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k.top_k(vectors, F.col("vec_id") % 20 == 0)


@query
def op5_secrets(spark, sf_dir):
    return secret_scan.scan(documents(spark, sf_dir))


@query
def op6_toxicity(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scorer = toxicity.train(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    scored = toxicity.score_documents(docs, scorer)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


@query
def op7_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = string_kernel.train(docs, remainder(F.col("doc_id"), 3) != 1)
    named = string_kernel.identify(docs, model)
    return named.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


@query
def op8_pieces(spark, sf_dir):
    return piece_codec.encode_and_decode(documents(spark, sf_dir), piece_model())


@query
def op9_url_verdicts(spark, sf_dir):
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def op10_leaks(spark, sf_dir):
    found = decontamination.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "score", "start", "stop")


@query
def op11_mix(spark, sf_dir):
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op12_fill_in_middle(spark, sf_dir):
    return fill_in_middle.digests(fill_in_middle.transform(documents(spark, sf_dir)))


@query
def op13_turn_repair(spark, sf_dir):
    return turn_repair.repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# Groups and types of op2 in SQL; DuckDB has sha1() in hex, and its base32 is spelt out of groups of five bits.
ORACLE["op4_top_k"] = """
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM kept q JOIN kept c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

ORACLE["op2_revisits"] = """
WITH headed AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hexed FROM pages
), coded AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hexed, CAST(1 + 5 * (k // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest
  FROM headed
), grouped AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM coded)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM grouped
"""

ORACLE["op11_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS key,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), ' ') || ':' || coalesce(text, '')), 1, 8) AS BIGINT) AS draw
  FROM documents
), sources AS (
  SELECT key, min(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY key
), weighed AS (
  SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5 - coalesce(sum(2.0 * source_size) OVER (full_first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (full_first ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW full_first AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST)
), goals AS (
  SELECT key, source_size, least(2.0 * source_size, max(level) OVER () * weight) AS target,
    CAST('0x' || substr(md5('42:' || key), 1, 7) AS BIGINT) AS start
  FROM levels
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY
    greatest(length(bin(size)) - 6, 0) * 32 + (size >> greatest(length(bin(size)) - 6, 0)) DESC, draw, doc_id, size) - 1 AS place
  FROM sized
), rated AS (
  SELECT p.*, source_size, target, start, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 268435456) AS BIGINT) ELSE 0 END AS rate
  FROM placed p JOIN goals USING (key)
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST((((place % 268435456) * rate + start) % 268435456 + rate) // 268435456 * size AS BIGINT) AS taken
FROM rated
"""

ORACLE["op12_fill_in_middle"] = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hexed
  FROM documents
), drawn AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, [CAST('0x' || substr(hexed, 1 + 8 * k, 8) AS BIGINT) FOR k IN [0, 1, 2, 3]] AS h FROM cut
), formed AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
      WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
    coalesce(array_to_string(units[b + 1:], ''), '') AS suffix
  FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
