"""Secret scans with corpus-wide ownership.

Every text is scanned once for base spans (assign, access, hex) and for further candidates: long tokens of letters and digits
with high entropy that touch no base span. Only the hashes of candidates are then counted: distinct repositories per owner,
then owners per hash, both combined before their shuffles. A candidate of one owner is taken for live and adds a span
`live`; one that several owners hold is a copied example and adds none. Base spans always stay.

A source `owner/repository` is a repository of that owner; a source without a slash is its own owner.

Defined cases: a NULL text is an empty one, with no span; a NULL source is one unnamed owner; offsets are code points; repeated
rows are scanned like others and are one owner; a text with many secrets is joined secret by secret, never collected with
other texts.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame, functions as F

from vitrina.llm.common import map_rows
from vitrina.sources.staging import stage_table

# Fixed patterns of the base kinds, in the order in which equal starts are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the runs of AKIA[A-Z0-9]+ with 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ with 24 characters or more
KINDS = ("assign", "access", "hex", "live")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_VALUE = 6
LEAST_ENTROPY = 3.2
LIVE_OWNERS = 1
SCANNED = (
    "row_key string, n_assign long, n_access long, n_hex long, base string, "
    "candidates array<struct<kind:string,start:int,stop:int,hash:string>>"
)


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind as listed."""
    out = [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    out += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def further_candidates(text: str, base: list) -> list[tuple[str, int, int, str]]:
    """Tokens with letters and digits and enough entropy, outside all base spans."""
    out = []
    starts = [s[1] for s in base]
    stops = list(accumulate((s[2] for s in base), max))
    for m in TOKEN.finditer(text):
        value = m[0]
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and _entropy(value) >= LEAST_ENTROPY:
            before = bisect_left(starts, m.end())  # base spans that start before the end of the token
            if not before or stops[before - 1] <= m.start():
                out.append(("live", *m.span(), value))
    return out


def _scan(part) -> dict:
    out = {name: [] for name in ("row_key", "n_assign", "n_access", "n_hex", "base", "candidates")}
    run = uuid.uuid4().hex
    for number, text in enumerate(part.column("text").to_pylist()):
        text = text or ""
        base = base_spans(text)
        more = further_candidates(text, base)
        kinds = Counter(s[0] for s in base)
        out["row_key"].append(f"{run}-{number}")  # names the row from now on: the scan is written once and reread
        for kind in KINDS[:3]:
            out[f"n_{kind}"].append(kinds[kind])
        out["base"].append(",".join(f"{k}:{a}:{b}" for k, a, b, _ in base))
        out["candidates"].append([(k, a, b, hashlib.sha256(v.encode()).hexdigest()) for k, a, b, v in [*base, *more]])
    out["candidates"] = [[dict(zip(("kind", "start", "stop", "hash"), c)) for c in row] for row in out["candidates"]]
    return out


def scan(docs: DataFrame, keep=("doc_id",), live_owners: int = LIVE_OWNERS) -> DataFrame:
    """Spans and counts of every row; n_live and n_copied count all its candidates by ownership."""
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"))
    staged = stage_table(map_rows(rows, _scan, SCANNED, [*dict.fromkeys([*keep, "source"])]))
    found = staged.select("row_key", "source", F.explode("candidates").alias("c")).select("row_key", "source", "c.*")
    owner = F.substring_index("source", "/", 1)
    owners = (
        found.select("hash", owner.alias("owner"), F.col("source").alias("repository")).distinct()
        .groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
        .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
        .withColumnRenamed("hash", "owned_hash")
    )
    same = (F.col("hash") == F.col("owned_hash")) & (F.xxhash64("hash") == F.xxhash64("owned_hash"))
    live = F.col("owners") <= live_owners
    span = F.struct(F.col("start"), F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("order"), F.concat_ws(":", "kind", "start", "stop").alias("text"))
    verdicts = (
        found.join(owners, same)
        .groupBy(F.col("row_key").alias("key"))
        .agg(
            F.collect_list(F.when((F.col("kind") != "live") | live, span)).alias("all_spans"),
            F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_copied"),
            F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"),
        )
    )
    joined = staged.join(verdicts, F.col("row_key") == F.col("key"), "left")
    spans = F.array_join(F.transform(F.array_sort(F.coalesce("all_spans", F.array().cast("array<struct<start:int,order:bigint,text:string>>"))), lambda s: s["text"]), ",")
    return joined.select(
        *keep, "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce("most_owners", F.lit(0)).alias("most_owners"), F.coalesce("most_repositories", F.lit(0)).alias("most_repositories"),
    )
