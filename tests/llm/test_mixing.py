"""Mixing against a plain sampler, its targets against repeated resharing, and the emitted corpus against the counts."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vitrina.llm import mixing

DOCS = "doc_id long, text string, source string, size long, copies long, __key string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, "x") for i, t, s in rows], DOCS)


def reshared(sizes, weights, budget=1.5, most=2.0):
    """Targets by handing out and taking back until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {name: weights[k % len(weights)] for k, name in enumerate(names)}
    total, out, free = budget * sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(out.values())
        shares = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        above = [n for n in free if shares[n] > most * sizes[n]]
        if not above:
            out.update(shares)
            break
        for n in above:
            out[n] = most * sizes[n]
            free.discard(n)
    return out


def plain_mix(rows, weights=(3, 1, 2)):
    """Copies per (id, source, text) with exact running sums."""
    def size(text):
        return len([w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w])

    def klass(n):
        shift = max(0, n.bit_length() - 6)
        return shift * 32 + (n >> shift)

    def digits(text, n):
        return int(hashlib.md5(text.encode()).hexdigest()[:n], 16)

    by_source = defaultdict(list)
    for i, text, source in rows:
        draw = digits(f"42:{' ' if i is None else i}:{text or ''}", 8)
        by_source[source].append((-klass(size(text)), draw, -1 if i is None else i, size(text)))
    sizes = {s: sum(r[3] for r in members) for s, members in by_source.items()}
    goals, taken = reshared(sizes, weights), Counter()
    for source, members in by_source.items():
        rate = int(goals[source] / sizes[source] * 2**28) if sizes[source] else 0
        total = digits("42:" + ("" if source is None else "=" + source), 7)
        for _, draw, i, n in sorted(members):
            taken[source, draw, i, n] += (total + rate) // 2**28 - total // 2**28
            total += rate
    return taken, goals


def rows_of(seed, n=900):
    rng = random.Random(seed)
    sources = ["a", "b", "Z", "é", "", None, "a", "a", "a"]
    return [(k, " ".join("w" * rng.randint(1, 4) for _ in range(int(rng.paretovariate(0.9)) % 3000)), rng.choice(sources)) for k in range(n)]


def compared(spark, rows):
    got = mixing.mix(docs_of(spark, rows)).collect()
    want, goals = plain_mix(rows)
    ours = Counter()
    for r in got:
        ours[r.source, r.draw, -1 if r.doc_id is None else r.doc_id, r["size"]] += r.copies
        assert 0 <= r.copies <= 2 and r.target == pytest.approx(goals[r.source], rel=1e-9)
    assert len(got) == len(rows) and {k: v for k, v in ours.items() if v} == {k: v for k, v in want.items() if v}
    return got


def test_equal_to_a_plain_sampler(spark, monkeypatch):
    rows = rows_of(1)
    first = compared(spark, rows)
    monkeypatch.setattr(mixing, "ROWS_PER_CELL", 7)  # how the work is cut changes nothing
    again = compared(spark, rows[::-1])
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_words_taken_come_near_the_target(spark):
    rows = rows_of(2, 3000)
    taken, most = Counter(), Counter()
    goals = {}
    for r in mixing.mix(docs_of(spark, rows)).collect():
        taken[r.source] += r.copies * r["size"]
        most[r.source] = max(most[r.source], r["size"])
        goals[r.source] = r.target
    assert sum(goals.values()) == pytest.approx(1.5 * sum(len(t.split()) for _, t, _ in rows))
    for source, goal in goals.items():
        assert abs(taken[source] - goal) <= 1.1 * most[source]


def test_nulls_empty_texts_repeated_rows_and_hot_sources(spark):
    rows = [(None, None, None), (None, "a b", None), (1, "", "x"), (1, " \t\x0b ", "x"), (2, None, "x")]
    rows += [(None, "c d e", "hot")] * 400 + [(7, "c d", "hot")] * 50
    compared(spark, rows)
    assert mixing.mix(docs_of(spark, [])).collect() == []
    empty = mixing.mix(docs_of(spark, [(1, None, None), (2, " ", "a")])).collect()
    assert {(r["size"], r.target, r.copies) for r in empty} == {(0, 0.0, 0)}


def test_word_count_of_odd_and_long_texts(spark):
    texts = [None, "", " ", "a", " a ", "a\x0bb\x0cc\rd\te\nf", "a b c d", "😀 😀", "x " * 2_000_000, "y" * 3_000_000, " " * 1_000_000]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.word_count(F.col("text")).alias("n"))
    assert [r.n for r in frame.collect()] == [0, 0, 0, 1, 1, 6, 2, 2, 2_000_000, 1, 0]


def test_size_classes_are_monotone(spark):
    got = [r.k for r in spark.range(0, 20_000).select(mixing.size_class("id").alias("k")).collect()]
    assert got == sorted(got) and got[:64] == list(range(64))
    big = spark.createDataFrame([(1 << 40,), ((1 << 41) - 1,), (1 << 41,)], "id long").select(mixing.size_class("id").alias("k")).collect()
    assert big[0].k < big[1].k < big[2].k


def test_emitted_corpus_holds_every_copy(spark):
    rows = rows_of(3, 300) + [(None, "c d e", None)] * 20 + [(5, "same", "a")] * 9
    docs = docs_of(spark, rows)
    mixed = mixing.mix(docs)
    want = Counter()
    for r in mixed.collect():
        want[r.doc_id, r.source, r.draw] += r.copies
    emitted = mixing.emit(docs.drop("__key"), mixed)
    assert emitted.columns == ["doc_id", "text", "source", "size", "copies", "copy"]
    got = Counter((r.doc_id, r.source, r.draw) for r in emitted.withColumn("draw", mixing.draw(F.col("doc_id"), F.col("text"))).collect())
    assert got == Counter({k: v for k, v in want.items() if v})


def test_main_path_has_no_python(spark):
    text = mixing.mix(docs_of(spark, rows_of(4, 50)))._jdf.queryExecution().toString()
    assert "Python" not in text and "Pandas" not in text and "InArrow" not in text and "CartesianProduct" not in text
