"""Fill-in-middle against a plain cut in Python, its round trip, and long texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from vitrina.llm import fill_in_middle as fim

UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def plain(doc_id, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def texts_of(seed, n=400):
    rng = random.Random(seed)
    alphabet = ["a", "b", "é", "😀", " ", "  ", "\n", "\t", "\x0b", " ", " ", "<", ">", "P", "<P", "$1", "\\", "{", "[", "S>"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_equal_to_a_plain_cut(spark):
    texts = texts_of(1) + ["", None, " ", "\n \t", "<M>", "x<S>y", "a <P", "one", " one", "one "]
    rows = list(enumerate(texts)) + [(None, "no id at all"), (None, None), (3, "twice"), (3, "twice")]
    frame = fim.transform(spark.createDataFrame([(i, t, 1, "f") for i, t in rows], "doc_id long, text string, extra int, __text string"), ("doc_id", "extra"))
    got = [tuple(r) for r in frame.drop("extra").collect()]
    assert got == [(i, *plain(i, t)) for i, t in rows]
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = frame.select(fim.restore(F.col("output"), F.col("form")).alias("t")).collect()
    assert [r.t for r in back] == [t or "" for _, t in rows]
    digests = fim.digests(frame).collect()
    assert all(r.restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for r, (_, t) in zip(digests, rows))
    assert all(r.prefix_chars == (None if g[3] is None else len(g[3])) for r, g in zip(digests, got))


def test_very_long_texts(spark):
    texts = ["ab " * 400_000, "x" * 2_000_000, " " * 1_000_000, "\n".join(["wörd 😀"] * 200_000), "a" + " " * 1_000_000 + "b"]
    rows = [(k, t) for t in texts for k in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {(r.doc_id, r.n, r.form, r.p, r.o) for r in fim.transform(frame).select("doc_id", "n", "form", F.length("prefix").alias("p"), F.sha2("output", 256).alias("o")).collect()}
    want = set()
    for i, t in rows:
        n, form, p, _, _, out = plain(i, t)
        want.add((i, n, form, None if p is None else len(p), hashlib.sha256(out.encode()).hexdigest()))
    assert got == want


def test_shares_of_the_forms(spark):
    counts = {r.form: r["count"] for r in fim.transform(spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))).groupBy("form").count().collect()}
    assert abs(counts["plain"] - 10_000) < 400 and abs(counts["spm"] - 8_000) < 400 and abs(counts["psm"] - 2_000) < 250


def test_empty_tables_clashing_names_and_plan(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n int")
    assert fim.transform(empty).collect() == []
    with pytest.raises(ValueError, match="n$"):
        fim.transform(empty, ("doc_id", "n"))
    text = fim.digests(fim.transform(empty))._jdf.queryExecution().toString()
    assert "Python" not in text and "Exchange" not in text
