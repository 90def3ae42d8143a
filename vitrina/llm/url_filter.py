"""URL verdicts: rules of (host, path) first, boosted trees on lexical features for urls that no rule decides.

The labelled urls are those that a rule decides. Suffix statistics (rows and blocked share of the last label and of the last
two labels of a host) are counted over one half of the labelled urls, and the trees are fitted on a bounded sample of the
distinct urls of the other half, so that the statistics do not repeat the labels they are to explain.

Defined cases: a NULL url, or one without `://`, has an empty host and path, fits no rule and is judged by the trees; an empty
path starts with no rule's path; rows are judged one by one, so repeated rows agree; without labelled urls every verdict is
the default one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from vitrina.llm import boosting
from vitrina.llm.common import low_draws, map_rows
from vitrina.sources.staging import stage_table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SAMPLE = 20_000
SMOOTHING = 5.0
FEATURES = (
    "length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "entropy", "parameters", "hyphens",
    "longest_segment", "has_fragment", "letters", "tld_rows", "tld_blocked", "domain_rows", "domain_blocked",
)


def host_of(url: Column) -> Column:
    """Between the first `://` and the next `/`, `?`, `#` or end, A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^(?:(?!://).)*://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as (rule, verdict); ties go to the first in text order. NULL if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def _statistics(labelled: DataFrame, labels: int, prefix: str) -> DataFrame:
    rows = F.count("*").cast("double")
    blocked = (F.sum(F.col("blocked").cast("double")) + SMOOTHING / 2) / (rows + SMOOTHING)
    return (
        labelled.groupBy(_suffix(F.col("host"), labels).alias(f"{prefix}_suffix"))
        .agg(F.log1p(rows).alias(f"{prefix}_rows"), blocked.alias(f"{prefix}_blocked"))
        .where(F.col(f"{prefix}_suffix") != "")
    )


def with_statistics(rows: DataFrame, statistics: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """Join the statistics of the suffixes; a hash in the condition lets adaptive execution split hot suffixes."""
    for prefix, (table, labels) in statistics.items():
        key = f"{prefix}_key"
        rows = rows.withColumn(key, _suffix(F.col("host"), labels))
        same = (F.col(key) == F.col(f"{prefix}_suffix")) & (F.xxhash64(key) == F.xxhash64(f"{prefix}_suffix"))
        rows = rows.join(table, same, "left").drop(key, f"{prefix}_suffix")
        rows = rows.fillna({f"{prefix}_rows": 0.0, f"{prefix}_blocked": 0.5})
    return rows


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    counts = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)[1] / len(text)
    return float(-(counts * np.log2(counts)).sum())


def features(part) -> np.ndarray:
    """Feature rows, in the order of FEATURES."""
    out = np.zeros((part.num_rows, len(FEATURES)))
    columns = [part.column(c).to_pylist() for c in ("url", "host", "path", *FEATURES[-4:])]
    for k, (url, host, path, *suffixes) in enumerate(zip(*columns)):
        url = url or ""
        segments = [s for s in path.split("/") if s]
        query = url.partition("?")[2].partition("#")[0]
        digits = sum(c.isdigit() for c in url)
        out[k] = (
            len(url), len(host), len(path), len(segments), host.count(".") + 1 if host else 0, digits / max(1, len(url)),
            sum(c.isdigit() for c in host), _entropy(url), query.count("&") + 1 if query else 0, url.count("-"),
            max(map(len, segments), default=0), "#" in url, sum(c.isalpha() for c in url) / max(1, len(url)), *suffixes,
        )
    return out


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, default: str = "allow", sample: int = SAMPLE, keep=("page_id",)) -> DataFrame:
    """host, path, rule, verdict and score (probability of block by the trees, also where a rule decides) of every row."""
    url = F.col("url")
    rows = pages.select(*keep, url).withColumns({"host": host_of(url), "path": path_of(url)})
    rows = rows.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    # Urls are narrow; staged once, neither the counts nor the sample nor the scoring read the pages again.
    rows = stage_table(rows)
    labelled = rows.where("found IS NOT NULL").withColumn("blocked", (F.col("found.verdict") == "block").cast("int"))
    labelled = labelled.withColumn("draw", F.xxhash64("url"))
    counted = labelled.where("pmod(draw, 2) = 0")
    statistics = {"tld": (stage_table(_statistics(counted, 1, "tld")), 1), "domain": (stage_table(_statistics(counted, 2, "domain")), 2)}
    others = labelled.where("pmod(draw, 2) = 1")
    distinct = others.select("draw").distinct().count()
    drawn = others.where(low_draws(F.col("draw"), sample, distinct)).dropDuplicates(["draw"]).orderBy("draw").limit(sample)

    def lexical(part):
        return {"x": list(features(part)), "y": part.column("blocked")}

    columns = ["url", "host", "path", *FEATURES[-4:]]
    trained = map_rows(with_statistics(drawn, statistics).select(*columns, "blocked"), lexical, "x array<double>, y int").collect()
    x = np.array([r.x for r in trained]).reshape(len(trained), len(FEATURES))
    model = boosting.fit_trees(x, np.array([r.y for r in trained], float)) if trained else None

    def score(part):
        return {"score": model.probability(features(part)) if model else np.full(part.num_rows, float(default == "block"))}

    kept = [*keep, "host", "path", "found"]
    inputs = list(dict.fromkeys([*kept, *columns]))
    scored = map_rows(with_statistics(rows, statistics).select(*inputs), score, "score double", kept)
    by_trees = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(
        *keep, "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", by_trees).alias("verdict"), "score",
    )
