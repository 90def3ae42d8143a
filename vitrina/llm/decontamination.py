"""Benchmark decontamination: word n-grams as seeds, Smith-Waterman alignment of what they find.

The items are worked through in blocks whose size in bytes is bounded, so an index of one block fits a broadcast at any size
of the benchmark. Every n-gram of an item is a seed, however frequent it is, so each copied stretch of N words is found. One
pass finds the seeds in the documents, drops the items that cannot reach the threshold by upper bounds of their score (words
in common with the document, then with any window that an alignment can span), and aligns the text around the seeds of the
others; nothing but results leaves a task.

An item leaks into a document if the local alignment (2 a match, -1 a mismatch or gap) reaches `threshold` of the score of the
whole item. Words are lower-case runs of letters and digits.

Defined cases: NULL or empty texts match nothing; items with fewer than N words are left out; items with equal texts each
match; an item_id on several rows matches with its best row; repeated documents each give their rows; very long documents are
aligned around their seeds only, wherever these are.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, functions as F

from vitrina.llm.common import flat_map_rows, words

N = 3
THRESHOLD = 0.5
BLOCK_BYTES = 16 << 20
MATCH, MISMATCH, GAP = 2, -1, 1
LEAKS = "row_key long, doc_id long, item_id long, score double, start int, stop int"


class ItemIndex:
    """Vocabulary, word ids and n-grams of one block of items."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids, self.tokens, vocabulary = [], [], {}
        for item_id, text in items:
            tokens = words(text)
            if len(tokens) >= N:
                self.ids.append(item_id)
                self.tokens.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in tokens], np.int64))
        self.vocabulary = vocabulary
        self.base = np.int64(len(vocabulary) + 1)
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        grams = [self.grams(t) for t in self.tokens]
        self.keys, place = np.unique(np.concatenate(grams), return_inverse=True) if grams else (np.zeros(0, np.int64),) * 2
        owner = np.repeat(np.arange(len(grams)), self.sizes - N + 1)
        self.gram_starts = np.cumsum([0, *(len(g) for g in grams)])
        self.grams_of = place  # of item k: from gram_starts[k] on
        self.owners = owner[np.argsort(place, kind="stable")]
        self.owner_starts = np.searchsorted(np.sort(place), np.arange(len(self.keys) + 1))
        counted = [np.unique(t, return_counts=True) for t in self.tokens]
        self.word_starts = np.cumsum([0, *(len(w) for w, _ in counted)])
        self.words = np.concatenate([w for w, _ in counted]) if counted else np.zeros(0, np.int64)
        self.times = np.concatenate([n for _, n in counted]) if counted else np.zeros(0, np.int64)

    def grams(self, tokens: np.ndarray) -> np.ndarray:
        out = tokens[: len(tokens) - N + 1].copy()
        for k in range(1, N):
            out = out * self.base + tokens[k : len(tokens) - N + 1 + k]
        return out

    def read(self, text: str | None) -> np.ndarray:
        """Word ids of a text, -1 for words of no item."""
        tokens = words(text)
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a text and indices into `keys` of the n-grams that occur in it."""
        if len(ids) < N or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = ids >= 0
        whole = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
        key = (ids[whole] * self.base + ids[whole + 1]) * self.base + ids[whole + 2]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return whole[found], at[found]

    def candidates(self, ids: np.ndarray, grams: np.ndarray, threshold: float) -> np.ndarray:
        """Items with one of these n-grams that have enough words in common with the text: an alignment scores at most MATCH for each."""
        items = np.unique(self.owners[_ranges(self.owner_starts, grams)])
        have, times = np.unique(ids, return_counts=True)
        at = _ranges(self.word_starts, items)
        place = np.minimum(np.searchsorted(have, self.words[at]), len(have) - 1)
        common = np.where(have[place] == self.words[at], np.minimum(times[place], self.times[at]), 0)
        widths = self.word_starts[items + 1] - self.word_starts[items]
        return items[np.add.reduceat(common, np.cumsum(widths) - widths) >= threshold * self.sizes[items]]


def _ranges(starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Indices starts[r] .. starts[r + 1] - 1 of all rows, one after the other."""
    widths = starts[rows + 1] - starts[rows]
    return np.repeat(starts[rows] - np.cumsum(widths) + widths, widths) + np.arange(widths.sum())


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local score and the end (exclusive) in `text`, row by row; a row's gaps come from a running maximum."""
    previous = np.zeros(len(text) + 1, np.int64)
    ramp = GAP * np.arange(len(text) + 1)
    best, end = 0, 0
    for word in item:
        row = np.zeros(len(text) + 1, np.int64)
        row[1:] = np.maximum(previous[:-1] + np.where(text == word, MATCH, MISMATCH), previous[1:] - GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + ramp) - ramp
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
        previous = row
    return best, end


def _stretches(where: list[int], reach: int) -> list[tuple[int, int]]:
    """Ranges around seed positions, joined where they overlap."""
    out: list[list[int]] = []
    for at in sorted(where):
        if out and at - reach <= out[-1][1]:
            out[-1][1] = at + reach
        else:
            out.append([at - reach, at + reach])
    return [(max(0, a), b) for a, b in out]


def leaks_of(index: ItemIndex, ids: np.ndarray, threshold: float) -> list[tuple[int, float, int, int]]:
    """(item number, score, start, stop) of the items that leak into a text."""
    at, seed = index.hits(ids)
    if not len(at):
        return []
    order = np.argsort(seed, kind="stable")
    at, seed = at[order], seed[order]
    out = []
    for item in index.candidates(ids, np.unique(seed), threshold).tolist():
        tokens = index.tokens[item]
        grams = index.grams_of[index.gram_starts[item] : index.gram_starts[item + 1]]
        where = [(at[a:b] - offset) for offset, (a, b) in enumerate(zip(np.searchsorted(seed, grams), np.searchsorted(seed, grams, "right")))]
        needed = threshold * MATCH * len(tokens)
        # An alignment that scores enough has no room for more unmatched words than this.
        span = len(tokens) + int(MATCH * len(tokens) - needed) // GAP
        best = (0, 0, 0)
        for a, b in _stretches(np.unique(np.concatenate(where)).tolist(), len(tokens) + N):
            part = ids[a : b + len(tokens)]
            within = np.cumsum(np.isin(part, tokens))
            within[span:] -= within[:-span].copy()
            if MATCH * within.max(initial=0) < needed:
                continue
            score, end = align(tokens, part)
            best = max(best, (score, a + end - 1, a))
        if best[0] >= needed:
            out.append((item, best[0] / (MATCH * len(tokens)), max(best[2], best[1] + 1 - len(tokens)), best[1] + 1))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for every document row and item that leaks into it: row_key, doc_id, item_id, score, start, stop (words)."""
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // block_bytes)
    out = spark.createDataFrame([], LEAKS)
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        index = ItemIndex([(r.item_id, r.text) for r in mine.orderBy("item_id", "text").collect()])
        if index.ids:
            out = out.unionByName(_block_leaks(rows, index, threshold))
    return out


def _block_leaks(rows: DataFrame, index: ItemIndex, threshold: float) -> DataFrame:
    context = rows.sparkSession.sparkContext
    seeded = context.broadcast(index)

    def search(part):
        held, out = seeded.value, [[] for _ in range(6)]
        for key, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("row_key", "doc_id", "text"))):
            best = {}
            for item, score, start, stop in leaks_of(held, held.read(text), threshold):
                found = (score, -start, -stop)
                best[held.ids[item]] = max(found, best.get(held.ids[item], found))
            for item_id, (score, start, stop) in best.items():
                for column, value in zip(out, (key, doc_id, item_id, score, -start, -stop)):
                    column.append(value)
        return dict(zip(("row_key", "doc_id", "item_id", "score", "start", "stop"), out))

    return flat_map_rows(rows, search, LEAKS)


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents into which no item leaks, all columns."""
    leaked = find_leaks(docs, benchmark, threshold).select(F.col("row_key").alias("__leaked")).distinct()
    rows = docs.withColumn("__row_key", F.xxhash64("doc_id", "text"))
    return rows.join(leaked, F.col("__row_key") == F.col("__leaked"), "left_anti").drop("__row_key")
