"""Language identification with string kernels.

A text becomes the set of its character n-grams of one to three letters (lower case, other characters as one blank), hashed to
2^16 places. The blended-spectrum presence kernel of two texts is the size of the common set over the root of the product of
both sizes. Nyström: a bounded number of landmark texts spans the feature space; one-versus-rest kernel ridge regression is
solved in it. Since the kernel is linear in the presence vectors, landmarks and weights fold into one matrix, and batches of
presence rows are scored by one matrix product.

Training texts are a bounded sample: the `per_class` smallest hashes of each language, cut before the shuffle;
repeated rows are drawn once.

Defined cases: NULL texts and texts without a letter are `und` with score 0; very long texts are read whole; rows without id
or language never train; without training rows everything is `und`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vitrina.llm.common import low_draws, map_rows
from vitrina.sources.staging import stage_table

PLACES = 1 << 16
PER_CLASS = 800
LANDMARKS = 400
RIDGE = 1e-3
AT_ONCE = 128
_LETTER: list[np.ndarray] = []


def _letters(codes: np.ndarray) -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0][codes]


def presence(text: str | None) -> np.ndarray | None:
    """Places of the n-grams that occur; None if the text has no letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters(codes)
    if not letter.any():
        return None
    kept = letter | np.r_[True, letter[:-1]]  # of other characters, the first of a run stays as a blank
    a = np.where(letter, codes, 32)[kept].astype(np.uint64)
    a = np.concatenate([[np.uint64(32)], a, [np.uint64(32)]])
    seen = np.zeros(PLACES, bool)
    gram = np.zeros(len(a), np.uint64)
    for n in range(3):
        gram = gram[: len(a) - n] * np.uint64(0x110001) + a[n:]
        seen[((gram + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)] = True
    return seen


class Classifier:
    """Folded weights (PLACES x languages)."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    def predict(self, texts) -> tuple[list[str], list[float]]:
        rows = [presence(t) for t in texts]
        known = [k for k, r in enumerate(rows) if r is not None]
        names, scores = ["und"] * len(rows), [0.0] * len(rows)
        if not known or not self.languages:
            return names, scores
        p = np.stack([rows[k] for k in known]).astype(np.float32)
        value = (p @ self.weights) / np.sqrt(p.sum(1, keepdims=True))
        best = value.argmax(1)
        for k, b, v in zip(known, best, value):
            names[k], scores[k] = self.languages[b], float(np.clip((1 + v[b]) / 2, 0, 1))
        return names, scores


def fit(bits: np.ndarray, y: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Classifier:
    """Ridge regression in the Nyström space of the first `landmarks` texts, the classes taking turns."""
    languages = sorted(set(y))
    if not languages:
        return Classifier([], np.zeros((PLACES, 0), np.float32))
    turn = {lang: 0 for lang in languages}
    order = []
    for k, lang in enumerate(y):
        order.append((turn[lang], lang, k))
        turn[lang] += 1
    chosen = [k for _, _, k in sorted(order)[:landmarks]]
    unpack = lambda rows: np.unpackbits(rows, axis=1).astype(np.float32)
    marks = unpack(bits[chosen])
    marks /= np.sqrt(marks.sum(1, keepdims=True))
    k_nm = np.zeros((len(y), len(chosen)))
    for start in range(0, len(y), 256):
        part = unpack(bits[start : start + 256])
        k_nm[start : start + 256] = (part @ marks.T) / np.sqrt(part.sum(1, keepdims=True))
    values, vectors = np.linalg.eigh(k_nm[chosen])
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = k_nm @ root
    target = np.where(np.array(y)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    size = np.array([max(1, y.count(lang)) for lang in y], float)  # each language weighs the same
    weighted = phi / size[:, None]
    beta = np.linalg.solve(phi.T @ weighted + ridge / len(y) * np.eye(phi.shape[1]), weighted.T @ target)
    return Classifier(languages, (marks.T @ (root @ beta)).astype(np.float32))


def train(docs: DataFrame, usable: Column, per_class: int = PER_CLASS) -> Classifier:
    rows = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(usable)
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("draw"))
    # One row a language, as many as the model has classes. Repeated rows count once, here as in the sample.
    different = rows.select("lang", "draw").distinct()
    sizes = F.broadcast(stage_table(different.groupBy("lang").agg(F.count("*").alias("total"))))
    few = rows.join(sizes, "lang").where(low_draws(F.col("draw"), per_class, F.col("total"))).dropDuplicates(["lang", "draw"])
    smallest = F.row_number().over(W.partitionBy("lang").orderBy("draw"))
    drawn = few.withColumn("turn", smallest).where(F.col("turn") <= per_class).select("lang", "text", "draw")

    def pack(part):
        sets = [presence(t) for t in part.column("text").to_pylist()]
        return {"bits": pa.array([None if s is None else np.packbits(s).tobytes() for s in sets], pa.binary())}

    got = map_rows(drawn, pack, "bits binary", ("lang", "draw"), AT_ONCE).where("bits IS NOT NULL").select("lang", "draw", "bits").collect()
    got.sort(key=lambda r: (r.lang, r.draw))
    bits = np.array([np.frombuffer(r.bits, np.uint8) for r in got], np.uint8).reshape(len(got), PLACES // 8)
    return fit(bits, [r.lang for r in got])


def identify(docs: DataFrame, model: Classifier, keep=("doc_id",)) -> DataFrame:
    """lang_pred and score of every row. The weights (half a megabyte a language or less) go out as one broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights))

    def run(part):
        names, scores = Classifier(*shared.value).predict(part.column("text").to_pylist())
        return {"lang_pred": names, "score": scores}

    return map_rows(docs.select(*dict.fromkeys([*keep, "text"])), run, "lang_pred string, score double", keep, AT_ONCE)
