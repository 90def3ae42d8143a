"""Corpus operators against brute force, the reference library, exact round trips and held-out labels, on small tables."""

import base64
import hashlib
import math
import random
import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import compare
from vitrina.llm import (
    boosting, components, decontamination, near_copies, pii, piece_codec, queries, secret_scan, string_kernel, top_k, toxicity,
    url_filter, warc,
)
from vitrina.llm.common import low_draws

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, start=0):
    rows = [(start + k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def letters(seed, n=3000):
    """Words of invented letters, the same for the same seed."""
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equal_to_sql(spark, name):
    assert compare(spark, SF, name, queries.QUERIES[name], queries.ORACLE[name])[0] == ""


# --- pseudonyms ----------------------------------------------------------------------------------------------------------


def feistel(left, right, a, b, key, kind):
    for number in range(1, pii.ROUNDS + 1):
        half = left if number % 2 else right
        mixed = int(hashlib.sha256(f"{key}:{kind}:{number}:{half}".encode()).hexdigest()[:15], 16)
        if number % 2:
            right = (right + mixed % b) % b
        else:
            left = (left + mixed % a) % a
    return left, right


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = 2 * d if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10


def pseudonyms(spark, texts, **more):
    rows = pii.pseudonymise(docs_of(spark, texts), "k").orderBy("doc_id").collect()
    return [r.text for r in rows], [r.n_private for r in rows]


def test_cards_against_brute_force(spark):
    cards = ["4041894974608795", "4111 1111 1111 1111", "378282246310005"]
    new, count = pseudonyms(spark, [f"a {c}." for c in cards])
    assert count == [1, 1, 1]
    for card, text in zip(cards, new):
        got, digits = text[2:-1], re.sub(r"\D", "", card)
        n = len(digits) - 1
        left, right = feistel(int(digits[: n // 2]), int(digits[n // 2 : n]), 10 ** (n // 2), 10 ** (n - n // 2), "k", "card")
        body = f"{left:0{n // 2}d}{right:0{n - n // 2}d}"
        assert re.sub(r"\D", "", got) == body + str((10 - luhn(body + "0")) % 10)
        assert luhn(re.sub(r"\D", "", got)) == 0 and re.sub(r"\d", "9", got) == re.sub(r"\d", "9", card)


def test_cards_beside_other_numbers(spark):
    card, amex = "4111 1111 1111 1111", "3782 822463 10005"
    alone = {c: t[:-1] for c, t in zip((card, amex, "4111111111111111"), pseudonyms(spark, [f"{c}." for c in (card, amex, "4111111111111111")])[0])}
    cases = [
        ("card {} 12/25", card), ("{} 123", "4111111111111111"), ("item 12 {}", card), ("12 345 {} 12/25 678", card), ("7 {} 12", amex), ("{} 12.50", card),
        ("{0} {0} 77", card), ("1 2 3 4 5 6 7 8 9 {}", card), ("1234 {} 5678", card), ("{}-123", "4111111111111111"), ("{} 12ab", card),
    ]
    new, count = pseudonyms(spark, [text.format(c) for text, c in cases])
    assert new == [text.format(alone[c]) for text, c in cases]
    assert count == [1, 1, 1, 1, 1, 1, 2, 1, 1, 1, 1]
    # An unusual layout, and other kinds beside a card, within its run or not.
    new, count = pseudonyms(spark, ["12 37828 22463 10005 12/25", f"12 988-555-2485 {card}", f"{card} 24/12/2024", f"{card} 2024-12-24 219-09-9999", "7 " * 5_000 + card])
    assert count[:4] == [1, 2, 2, 3] and "10005" not in new[0] and new[0].startswith("12 ") and new[0].endswith(" 12/25")
    assert alone[card] in new[1] and "2485" not in new[1] and new[2].startswith(alone[card] + " ") and "24/12/2024" not in new[2]
    assert new[3].startswith(alone[card] + " ") and "2024-12-24" not in new[3] and "9999" not in new[3]
    assert new[4].endswith(alone[card])


def test_formats_links_and_cases(spark):
    texts = [
        None, "", "no number", "4041894974608796 is no card", "call +1 (988) 555-2485 or 988-555-2485", "on 2024-02-29 and 29/02/2024",
        "never 2023-02-30", "ip 70.123.182.155, not 300.1.1.1", "ssn 219-09-9999 not 000-12-3456", "mail bosbt.42@mail8.example.com!",
        "mail bosbt.42@mail8.example.com again 70.123.182.155", "x" * 200_000 + " 70.123.182.155", "v 3.0 4.0",
    ]
    new, count = pseudonyms(spark, texts)
    assert count == [0, 0, 0, 0, 2, 2, 0, 1, 1, 1, 2, 1, 0]
    assert new[:4] == texts[:4] and new[6] == texts[6] and new[12] == texts[12]
    phones = re.findall(r"\(?(\d{3})\)?[ -](\d{3})-(\d{4})", new[4])
    assert phones[0] == phones[1] != ("988", "555", "2485") and min(int(phones[0][0]), int(phones[0][1])) >= 200
    iso, local = re.findall(r"[\d/-]{10}", new[5])
    assert iso == "-".join(reversed(local.split("/"))) and iso != "2024-02-29"
    assert new[7].endswith(", not 300.1.1.1") and new[8].endswith("not 000-12-3456")
    assert new[9][5:-1] == new[10].split(" ")[1] and "bosbt" not in new[9] and new[9].endswith("@mail8.example.com!")
    assert new[10].split()[-1] == new[11].split()[-1] == new[7].split()[1].rstrip(",")


def test_feistel_is_a_permutation(spark):
    rows = spark.range(63).select(pii.feistel(F.floor(F.col("id") / 9), F.col("id") % 9, 7, 9, "k", "x").alias("p")).collect()
    assert {(r.p.l, r.p.r) for r in rows} == {(a, b) for a in range(7) for b in range(9)}
    assert (rows[20].p.l, rows[20].p.r) == feistel(2, 2, 7, 9, "k", "x")


def test_columns_stay(spark):
    frame = docs_of(spark, ["a 70.123.182.155"]).withColumn("kind", F.lit(1)).withColumn("tokens", F.lit("x"))
    assert pii.pseudonymise(frame, "k").columns == [*frame.columns, "n_private"]
    assert pii.pseudonymise(frame.limit(0), "k").count() == 0


# --- archives ------------------------------------------------------------------------------------------------------------


def test_archives(spark):
    pages = [(1, "u\r\nx", "same"), (5, None, "same"), (3, "u", "same"), (7, "u", None), (2, "u", ""), (None, "u", "alone"), (9, "u", "é\r\n\r\nWARC/1.1\r\n" * 3)]
    pages += [(5, "again", "same"), (None, "u", "null twins"), (None, "u", "null twins")]
    frame = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, payload int")
    got = warc.round_trip(frame).collect()
    assert len(got) == len(pages)
    ids = {}
    for page_id, _, html in pages:
        ids.setdefault(html or "", []).append(page_id)
    want = []
    for page_id, _, html in pages:
        raw = (html or "").encode()
        top = max((i for i in ids[html or ""] if i is not None), default=None)
        refers = top if top is not None and page_id != top else None
        want.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if refers else "response", refers))
    key = lambda r: str(tuple(r))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    assert warc.round_trip(frame, min_bytes=5).where("record_type = 'revisit'").count() == 0
    assert warc.round_trip(frame.limit(0)).count() == 0


# --- near copies ---------------------------------------------------------------------------------------------------------


def shingle_set(text):
    tokens = re.findall(r"\w+", (text or "").lower())
    return {tuple(tokens[k : k + 5]) for k in range(max(1, len(tokens) - 4))} if tokens else set()


def brute_near(texts):
    sets = [shingle_set(t) for t in texts]
    links = [[j for j in range(len(sets)) if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and sets[j]] for i in range(len(sets))]
    group = list(range(len(sets)))
    for _ in sets:
        group = [min([group[i], *(group[j] for j in links[i])]) for i in range(len(sets))]
    return group, [len(x) for x in links]


def near_texts():
    rng, words, texts = random.Random(3), letters(1), []
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 40, 120, 300]))]
        for _ in range(rng.randint(1, 30)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts + ["", None, "...", "one two", "One, two!", "one two three", " ".join(words * 10), " ".join(words * 10) + " x"]


def test_near_copies_against_brute_force(spark):
    texts = near_texts()
    rows = near_copies.near_copies(docs_of(spark, texts)).orderBy("doc_id").collect()
    group, links = brute_near(texts)
    assert len(rows) == len(texts)
    assert [r.class_id for r in rows] == group and [r.n_links for r in rows] == links
    kept = near_copies.keep_one(docs_of(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(group))


def test_blocks_of_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "NODE_BLOCK", 16)
    monkeypatch.setattr(near_copies, "CELL_BLOCK", 8)
    words = letters(9)[:200]
    texts = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in range(60)]
    rows = near_copies.near_copies(docs_of(spark, texts)).orderBy("doc_id").collect()
    group, links = brute_near(texts)
    assert [r.class_id for r in rows] == group and [r.n_links for r in rows] == links


def test_links_across_blocks_of_a_node(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "NODE_BLOCK", 4)
    rng, words = random.Random(12), letters(12)
    text, texts = [rng.choice(words) for _ in range(150)], []
    for _ in range(80):  # every text differs a little from the one before, so the ends of the chain share little
        text = list(text)
        text[rng.randrange(150)] = rng.choice(words)
        texts.append(" ".join(text))
    rng.shuffle(texts)
    rows = near_copies.near_copies(docs_of(spark, texts)).orderBy("doc_id").collect()
    group, links = brute_near(texts)
    assert [r.class_id for r in rows] == group and [r.n_links for r in rows] == links


def test_near_copies_cases(spark):
    text = " ".join(letters(4)[:50])
    frame = spark.createDataFrame([(1, text, 0), (1, text, 0), (2, text, 1), (None, text + " b", 2), (None, None, 3), (4, "", 4)], "doc_id long, text string, key int")
    rows = near_copies.near_copies(frame).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in rows) == [
        ("1", "1", 3), ("1", "1", 3), ("2", "1", 3), ("4", "4", 0), ("None", "1", 3), ("None", "None", 0)]
    kept = near_copies.keep_one(frame)
    assert kept.columns == frame.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "None"]
    assert near_copies.near_copies(frame.limit(0)).count() == 0


def test_repeated_rows_are_compared_once(spark, monkeypatch):
    def counting(depth):
        def run(table):
            first = table.column("text_key")[0].as_py()
            return pa.table({"text_key": [first], "n_texts": [table.num_rows], "n_documents": [0], "expected": [0.0], "root": [first]})

        return run

    words = letters(5)[:60]
    text, near = " ".join(words), " ".join(words[:-1])
    docs = spark.createDataFrame([(1, text)] * 150 + [(2, near)] + [(None, near)] * 150, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.class_id, r.n_links, r.n_similar_texts) for r in near_copies.near_copies(docs).collect()}
    assert got == {(1, 1, 300, 1), (2, 1, 300, 1), (None, 1, 300, 1)}
    keys = {t: near_copies._sign(pa.table({"text": [t]}))["text_key"][0] for t in (text, near)}
    chosen = docs.where("doc_id = 1 OR doc_id IS NULL").groupBy("text").agg(F.min(F.xxhash64("doc_id", "text")).alias("row_key"))
    chosen = chosen.select(F.when(F.col("text") == text, keys[text]).otherwise(keys[near]).alias("text_key"), "row_key", F.lit(150).cast("long").alias("copies"))
    families = spark.createDataFrame([(k, keys[text]) for k in keys.values()], "node string, root string")
    monkeypatch.setattr(near_copies, "_verify", counting)
    assert [r.n_texts for r in near_copies.verify(docs, chosen, families, 5).collect()] == [2]


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"{rng.randrange(80):03d}", f"{rng.randrange(80):03d}") for _ in range(50)] + [(f"z{k:03d}", f"z{k + 1:03d}") for k in range(40)]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = components.components(spark.createDataFrame(edges, "a string, b string")).collect()
    assert {r.node: r.root for r in got} == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}


# --- top k ---------------------------------------------------------------------------------------------------------------


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=4).round(1)]) for k in range(300)]
    rows += [(k, [1.0, 1.0, 0.0, 0.0]) for k in range(300, 400)]  # many ties
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0]), (402, [math.nan, 0.0, 0.0, 0.0]), (403, [math.inf, 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    rows += [(420, [1.0, 2.0]), (421, [3.0, 1.0]), (440, [5.0]), (460, []), (500, [2.0**20, 1.0, 1.0, 1.0]), (301, [1.0, 1.0, 0.0, 0.0])]
    rows += [(7, [9.0, 1.0, 0.0, 2.0]), (40, [3.0, 0.5, 0.0, 1.0]), (40, [3.0, 0.5, 0.0, 1.0])]  # ids on several rows
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, score int")
    got = [tuple(r) for r in top_k.top_k(frame, F.col("vec_id") % 20 == 0, slice_rows=37, query_block=5).collect()]
    held = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, vector in held:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(vector, v)), i) for i, v in held if i != q and len(v) == len(vector))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:20])]
    assert sorted(got) == sorted(want)
    assert top_k.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# --- secrets -------------------------------------------------------------------------------------------------------------


def base_by_definition(text):
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    assign = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in assign.split(")")[0]) + ")" + assign.split(")", 1)[1]
    out = [("assign", m.start(), m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_secrets_by_definition(spark):
    rng = random.Random(5)
    parts = ["password", "Token", "apikey", "API_KEY", "=", ":", " ", '"', "'", "AKIA", "AKIA" + "Q" * 16, "ab12" * 6, "deadbeef", "x", "é", "ſecret=abcdefgh", "s3cr3tV4lue", "_", "\n", "Zq9+/" * 5]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", "k" * 100_000, "token=abcde", "token=abcdef"]
    rows = secret_scan.scan(docs_of(spark, texts)).orderBy("doc_id").collect()
    for text, row in zip(texts, rows):
        spans = base_by_definition(text or "")
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest(), text
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
        listed = row.spans.split(",") if row.spans else []
        assert [s for s in listed if not s.startswith("live:")] == [f"{k}:{a}:{b}" for k, a, b in spans]
        assert [int(s.split(":")[1]) for s in listed] == sorted(int(s.split(":")[1]) for s in listed)


def test_further_candidates_touch_no_base_span():
    token, key = "Zx9Qw8Er7Ty6Ui5Op4As3Df2", "0123456789abcdef01234567"
    text = f"{token} password={token} x {key} AKIA{key.upper()} {key}{token} {token}"
    base = secret_scan.base_spans(text)
    spans = [c[1:3] for c in secret_scan.further_candidates(text, base)]
    free = [m.span() for m in secret_scan.TOKEN.finditer(text) if all(m.end() <= s[1] or m.start() >= s[2] for s in base)]
    assert spans == free and (0, len(token)) in spans and (len(text) - len(token), len(text)) in spans


def test_ownership_separates_copies(spark):
    own, shared = "Xk3Lq9Pz7Rt2Wv8Yb4Nm", "Qw5Er6Ty7Ui8Op9As1Df"
    rows = [(1, f"a {own} b", "ann/one"), (2, f"{own}", "ann/two"), (3, f"{shared} x", "bob/one"), (4, f"y {shared}", None), (4, f"y {shared}", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.spans, r.n_live, r.n_copied) for r in secret_scan.scan(frame).collect())
    assert got == [(1, "live:2:22", 1, 0), (2, "live:0:20", 1, 0), (3, "", 0, 1), (4, "", 0, 1), (4, "", 0, 1)]
    assert secret_scan.scan(frame.limit(0)).count() == 0


# --- trained models ------------------------------------------------------------------------------------------------------


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit_trees(x[:1000], y[:1000])
    assert ((model.probability(x[1000:]) > 0.5) == y[1000:]).mean() > 0.95
    assert boosting.fit_trees(x[:0], y[:0]).probability(x[:3]).tolist() == [0.5] * 3
    knots = boosting.fit_isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.4]), np.array([0, 1, 0, 1, 1]))
    assert boosting.calibrated(np.array([0.1, 0.2, 0.25, 0.4]), knots).tolist() == [0, 0.5, 0.5, 1]


def test_nearness_against_all_pairs():
    rng = random.Random(5)
    for _ in range(200):
        hits, others = (sorted(rng.sample(range(60), rng.randrange(12))) for _ in range(2))
        assert toxicity._near(hits, others) == sum(any(abs(h - o) <= toxicity.NEAR for o in others) for h in hits)


def test_low_draws_hold_the_sample(spark):
    rows = spark.range(50_000).withColumn("draw", F.xxhash64("id"))
    chosen = rows.where(low_draws(F.col("draw"), 1000, 50_000))
    assert 1000 < chosen.count() < 1500
    smallest = [r.draw for r in rows.orderBy("draw").limit(1000).collect()]
    assert [r.draw for r in chosen.orderBy("draw").limit(1000).collect()] == smallest
    for total in (0, 900, 1250):
        assert rows.where(low_draws(F.col("draw"), 1000, total)).count() == 50_000


def test_toxicity_held_out(spark):
    words, rng = letters(6), random.Random(8)
    bad = ["idiot", "scum", *(f"vrk{w}" for w in words[:40])]
    texts, labels = [], []
    for k in range(600):
        text = [rng.choice(words) for _ in range(60)]
        if k % 5 == 0:
            for _ in range(5):
                text[rng.randrange(60)] = rng.choice(bad)
        texts.append(" ".join(text))
        labels.append((k, int(k % 5 == 0)))
    docs = docs_of(spark, texts)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    scorer = toxicity.train(docs, marks, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    rows = toxicity.score_documents(docs, scorer).collect()
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in rows]) > 0.95
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "idiot you scum " * 20_000)], "doc_id long, text string")
    scored = toxicity.score_documents(odd, scorer).collect()
    assert len(scored) == 4 and all(0 <= r.score <= 1 for r in scored) and scored[0].score == scored[1].score == scored[2].score
    none = toxicity.train(docs, marks.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score_documents(docs, none).collect()} == {0.0}


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries.QUERIES["op7_language"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.9
    model = string_kernel.train(docs, F.lit(True))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 ..."), (4, "the of and that " * 30_000)], "doc_id long, text string")
    rows = {r.doc_id: (r.lang_pred, r.score) for r in string_kernel.identify(odd, model).collect()}
    assert [rows[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3 and rows[4][0] == "en" and 0 <= rows[4][1] <= 1
    empty = string_kernel.train(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in string_kernel.identify(odd, empty).collect()} == {"und"}


def test_kernel_scores_are_the_folded_kernel():
    texts = ["the of and", "der die das und", "of the that and", "und das ist der"]
    sets = [string_kernel.presence(t) for t in texts]
    model = string_kernel.fit(np.array([np.packbits(s) for s in sets]), ["en", "de", "en", "de"])
    p = np.array(sets, float)
    kernel = (p @ p.T) / np.sqrt(np.outer(p.sum(1), p.sum(1)))
    target = np.array([[-1, 1], [1, -1], [-1, 1], [1, -1]], float)  # columns de, en
    alpha = np.linalg.solve(kernel + string_kernel.RIDGE / 4 * 2 * np.eye(4), target)
    value = (p / np.sqrt(p.sum(1, keepdims=True))) @ model.weights
    assert np.abs(value - kernel @ alpha).max() < 1e-2


# --- pieces --------------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(spark):
    import sentencepiece

    model = queries.piece_model()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(11)
    alphabet = list("aaab  ▁\n\t<>0x41éß中😀\u0301\x00ltheerrinn.=  ")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["a" * 2001, " " * 500, "", None, "the " * 30_000, "▁" * 9, "<s></s><unk><0x41>", "the" * 900]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    rows = piece_codec.encode_and_decode(docs_of(spark, texts), model, digests=False).orderBy("doc_id").collect()
    for text, row in zip(texts, rows):
        ids = library.encode(text or "")
        assert row.ids == ids and row.n_tokens == len(ids) and row.decoded == library.decode(ids)
    digest = piece_codec.encode_and_decode(docs_of(spark, ["", "ab c"]), model).orderBy("doc_id").collect()
    assert digest[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert digest[1].decoded_sha256 == hashlib.sha256(b"ab c").hexdigest()


# --- urls ----------------------------------------------------------------------------------------------------------------


def test_url_rules_by_definition(spark):
    urls = [
        None, "", "example.net/en/", "http://example.net/en/x", "http://a.EXAMPLE.net/en", "x://net", "x://net/", "http://Example.COM/de/q?x#y", "http://example.com/DE/",
        "a://b.org/fr/://c.net/", "http://xorg/fr/", "http://org/fr/?a", "http://h.net?x/y", "http://h.net#/", "://net/\n", "http://u@h.net:80/en/", "a:/b://c.net/d",
    ] + [f"http://h{k}.example.{'net' if k % 2 else 'org'}/fr/{k}" for k in range(60)]
    frame = spark.createDataFrame([(k, u, 0) for k, u in enumerate(urls)], "page_id long, url string, rule int")
    rows = {r.page_id: r for r in url_filter.judge(frame).collect()}
    assert len(rows) == len(urls)
    for k, url in enumerate(urls):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = []
        for rule, verdict in url_filter.RULES:
            own, rest = rule.split("/", 1)
            if (host == own or host.endswith("." + own)) and path.startswith("/" + rest):
                fits.append((len(rule), rule, verdict))
        assert (rows[k].host, rows[k].path, rows[k].rule) == (host, path, max(fits)[1] if fits else None), url
        assert rows[k].verdict == max(fits)[2] if fits else rows[k].verdict in ("allow", "block")
    assert url_filter.judge(frame.limit(0)).count() == 0


# --- benchmark leaks -----------------------------------------------------------------------------------------------------


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_leaks_against_brute_force(spark):
    rng, words = random.Random(13), letters(12)
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(12, 45)))) for k in range(15)]
    items += [(20, None), (21, "two words"), (22, "")]
    texts = [None, "", "..."]
    for k in range(60):
        text = [rng.choice(words) for _ in range(120)]
        if k % 2:
            leak = items[k % 15][1].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                leak[rng.randrange(len(leak))] = rng.choice(words)
            if k % 7 == 0:
                del leak[len(leak) // 2]
            leak = leak[: max(6, int(len(leak) * rng.choice([1, 1, 0.8, 0.3])))]
            text[50 : 50 + len(leak)] = leak
        texts.append(" ".join(text))
    texts.append(" ".join(words * 5) + " " + items[0][1].upper())
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_leaks(docs_of(spark, texts), benchmark).collect()
    got = {(r.doc_id, r.item_id): r.score for r in found}
    want = {}
    for d, text in enumerate(texts):
        b = re.findall(r"\w+", (text or "").lower())
        for item_id, item in items[:15]:
            a = item.split()
            if len(set(a) & set(b)) * 3 > len(set(a)):
                score = smith_waterman(a, b) / (2 * len(a))
                if score >= decontamination.THRESHOLD:
                    want[d, item_id] = score
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and len(got) > 15
    in_blocks = decontamination.find_leaks(docs_of(spark, texts), benchmark, block_bytes=700).collect()
    assert {(r.doc_id, r.item_id): r.score for r in in_blocks} == got
    clean = decontamination.without_leaks(docs_of(spark, texts), benchmark)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(set(range(len(texts))) - {d for d, _ in got})
    assert clean.columns == docs_of(spark, [""]).columns
    assert decontamination.find_leaks(docs_of(spark, texts), benchmark.limit(0)).count() == 0


def test_edited_copy_in_many_documents(spark):
    """Every sixth word changed: the intact n-grams are in all documents, those over the changed words in none."""
    rng, words = random.Random(17), letters(18)
    item = words[:36]
    copy = [words[40 + k] if k % 6 == 5 else w for k, w in enumerate(item)]
    texts = [" ".join([*(rng.choice(words[100:]) for _ in range(20)), *copy, *(rng.choice(words[100:]) for _ in range(20))]) for _ in range(120)]
    found = decontamination.find_leaks(docs_of(spark, texts), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in found) == list(range(120))
    assert {r.score for r in found} == {smith_waterman(item, copy) / 72} and 0.5 < found[0].score < 0.8


# --- pipeline ------------------------------------------------------------------------------------------------------------


def test_pipeline_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step, sizes = docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, SF)
        assert step.columns == docs.columns
        sizes.append(step.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] / 2
    kept = [r.text for r in step.collect()]
    assert len(set(kept)) == len(kept)
    assert not any(re.search(r"bosbt|\b4041894974608795\b", t) for t in kept)
    final = corpus_pipeline.STAGES[-1][1](spark, step, SF)
    assert final.count() == sizes[-1] and corpus_pipeline.run(spark, SF).count() == sizes[-1]


def test_pipeline_cases(spark, tmp_path):
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b", None, None, 3)], DOCS)
    odd = odd.withColumns({n: F.lit("own") for n in ("score", "predicted", "row_key", "leaked", "n_private", "text_key", "class_id", "kept_key")})
    for rows in (odd, odd.limit(0)):
        step = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            step = stage(spark, step, str(tmp_path))
            assert step.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, step, str(tmp_path)).count() == rows.count()


def test_plans_of_native_operators(spark):
    text = queries.QUERIES["op1_pii"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow|Exchange", text)
    assert Path(sys.modules["corpus_pipeline"].__file__).parent == Path(__file__).resolve().parents[2]
