"""Toxicity: boosted trees over dense features of a whole text, calibrated by isotonic regression.

Training rows fall into three folds by a hash of id and text. The lexicon fold gives the words and word beginnings that are
far more frequent in toxic texts (document counts); the other two fit the trees and the calibration. All three are bounded samples
(`lexicon_rows`, `sample` and `sample` different rows, smallest hashes first), chosen from ids and hashes alone, so that only the
texts of chosen rows leave the scan. The folds keep the lexicon from being judged by its own rows.

Features: densities, counts and distinct entries of the learned words, the learned beginnings, a list of common insults and
the same after undoing look-alike characters; second person near such words; capitals, punctuation, exclamation and
obfuscation rates; lengths.

Defined cases: NULL and empty texts have all features 0 and get the score of such a text; very long texts are read whole; a
document with several labels counts as toxic if one of them says so; without labels every score is 0; rows without id never
train; repeated rows train once; an empty table gives an empty result; a kept column may not have the name of a new one. Language, source and id are no inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from vitrina.llm import boosting
from vitrina.llm.common import flat_map_rows, low_draws, map_rows, words
from vitrina.sources.staging import stage_table

INSULTS = frozenset("idiot stupid moron loser scum trash worthless pathetic disgusting clown dumb fool jerk".split())
SECOND_PERSON = frozenset("you your yours u ur du dich dein deine ihr tu te toi ton ta vous votre usted ustedes tus ti".split())
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
OBFUSCATED = re.compile(r"(?<!\S)(?=\S*[^\W\d_])\S*[^\W\d_][0-9@$!*#]+[^\W\d_]\S*|(?<!\w)(?:[^\W\d_][.\-*_ ]){3,}[^\W\d_](?!\w)")
SAMPLE = 15_000
LEXICON_ROWS = 60_000
LEXICON = 20_000
NEAR = 6
BEGINNINGS = (4, 5)
LEAST_DOCS, LEAST_ODDS = 4, 12.0
FEATURES = 22


def terms(text: str | None) -> set[str]:
    """Words of three letters or more, and the beginnings of longer ones marked with their length."""
    out = set()
    for word in set(words(text)):
        if len(word) >= 3:
            out.add(word)
            out.update(f"{n}:{word[:n]}" for n in BEGINNINGS if len(word) > n)
    return out


def _counted(part) -> dict:
    toxic, clean = Counter(), Counter()
    for text, label in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
        (toxic if label else clean).update(terms(text))
    keys = list(toxic.keys() | clean.keys())
    return {"term": keys, "toxic": [toxic[k] for k in keys], "clean": [clean[k] for k in keys]}


def learn_lexicon(rows: DataFrame, n_toxic: int, n_clean: int, size: int = LEXICON) -> frozenset[str]:
    """Terms whose share among toxic texts is at least LEAST_ODDS times that among others; the strongest `size`."""
    counts = stage_table(
        flat_map_rows(rows.select("text", "toxic"), _counted, "term string, toxic long, clean long", at_once=2048)
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= LEAST_DOCS)
    )
    odds = (F.col("toxic") / max(1, n_toxic)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    ranked = counts.withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    best = ranked.orderBy(F.col("odds").desc(), F.col("toxic").desc(), "term").limit(size)
    return frozenset(row.term for row in best.select("term").collect())


def features(text: str | None, lexicon: frozenset[str], word_cache: dict) -> list[float]:
    """One row of FEATURES numbers. `word_cache` remembers what the lexicons say about a word."""
    if not text:
        return [0.0] * FEATURES
    tokens = words(text)
    n = max(1, len(tokens))
    flags = []
    for word in tokens:
        flag = word_cache.get(word)
        if flag is None:
            plain = word.translate(LOOKALIKES)
            learned = len(word) >= 3 and word in lexicon
            begins = sum(len(word) > k and f"{k}:{word[:k]}" in lexicon for k in BEGINNINGS)
            flag = (learned, begins, word in INSULTS, plain != word and (plain in INSULTS or plain in lexicon), word in SECOND_PERSON)
            if len(word_cache) > 300_000:
                word_cache.clear()
            word_cache[word] = flag
        flags.append(flag)
    learned = [k for k, f in enumerate(flags) if f[0]]
    begins = [k for k, f in enumerate(flags) if f[1]]
    insults = [k for k, f in enumerate(flags) if f[2]]
    hidden = sum(f[3] for f in flags)
    hits = sorted({*learned, *begins, *insults})
    you = [k for k, f in enumerate(flags) if f[4]]
    near = _near(hits, you)
    letters = max(1, len(text) - sum(map(text.count, " \n")))
    upper = sum(map(str.isupper, text))
    marks = sum(map(text.count, ".,;:!?*#%&$@"))
    obfuscated = len(OBFUSCATED.findall(text))
    most = max((j - i + 1 for i, j in _dense(hits)), default=0)
    return [
        len(learned), len(learned) / n, len({tokens[k] for k in learned}), len(begins), len(begins) / n, len({tokens[k] for k in begins}),
        sum(f[1] for f in flags) / n, len(insults), len(insults) / n, len({tokens[k] for k in insults}), hidden, hidden / n, near, near / n,
        len(you) / n, upper / letters, marks / letters, text.count("!") / letters, obfuscated / n, float(np.log1p(len(tokens))),
        len(text) / n, most,
    ]


def _near(hits: list[int], others: list[int]) -> int:
    """How many hits have one of the others within NEAR words; both sorted."""
    places = np.array([-NEAR - 1, *others, hits[-1] + NEAR + 1] if hits else [], np.int64)
    at = np.searchsorted(places, hits)
    return int((np.minimum(places[at] - hits, np.subtract(hits, places[at - 1])) <= NEAR).sum()) if hits else 0


def _dense(hits: list[int], span: int = 50):
    """Index ranges of hits that lie within `span` words of each other, widest for each start."""
    end = 0
    for start, at in enumerate(hits):
        while end + 1 < len(hits) and hits[end + 1] - at <= span:
            end += 1
        yield start, end


class Scorer:
    """A fitted model. It is small (lexicon and trees of fixed size) and travels with the tasks."""

    def __init__(self, lexicon, trees, knots):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def matrix(self, texts) -> np.ndarray:
        if not hasattr(self, "cache"):
            self.cache = {}
        return np.array([features(t, self.lexicon, self.cache) for t in texts], float).reshape(len(texts), FEATURES)

    def score(self, texts) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(texts))
        return boosting.calibrated(self.trees.probability(self.matrix(texts)), self.knots)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "cache"}


def _choose(marked: DataFrame, sizes: dict[int, int], folds: range, use: str, most: int) -> DataFrame:
    """The `most` smallest hashes of some folds, from narrow rows (doc_id, draw, toxic)."""
    total = sum(sizes.get(k, 0) for k in folds)
    within = F.pmod(F.col("draw"), F.lit(10)).between(folds[0], folds[-1]) & low_draws(F.col("draw"), most, total)
    return marked.where(within).orderBy("draw", "doc_id").limit(most).withColumn("use", F.lit(use))


def chosen_rows(docs: DataFrame, labels: DataFrame, usable: Column, sample: int, lexicon_rows: int) -> DataFrame:
    """Texts for the lexicon, the trees and the calibration: doc_id, draw, toxic, use, text; every (id, text) once.

    The choice is made on ids and hashes alone. Its size is bounded, so it is sent to the scan that picks up the texts.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.where("doc_id IS NOT NULL").where(usable).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("draw", F.xxhash64("doc_id", "text"))
    marked = stage_table(rows.select("doc_id", "draw").distinct().join(marks, "doc_id"))
    fold = F.pmod(F.col("draw"), F.lit(10))
    sizes = {r.fold: r["count"] for r in marked.groupBy(fold.alias("fold")).count().collect()}
    uses = (("lexicon", range(5), lexicon_rows), ("trees", range(5, 8), sample), ("calibration", range(8, 10), sample))
    parts = [_choose(marked, sizes, folds, use, most) for use, folds, most in uses]
    chosen = stage_table(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return stage_table(rows.join(F.broadcast(chosen), ["doc_id", "draw"]).dropDuplicates(["doc_id", "draw"]))


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE, lexicon_rows: int = LEXICON_ROWS) -> Scorer:
    """Fit on documents for which `usable` holds and a label exists."""
    chosen = chosen_rows(docs, labels, usable, sample, lexicon_rows)
    counts = {r.toxic: r["count"] for r in chosen.where("use = 'lexicon'").groupBy("toxic").count().collect()}
    empty = Scorer(learn_lexicon(chosen.where("use = 'lexicon'"), counts.get(1, 0), counts.get(0, 0)), None, None)

    def dense(part):
        return {"x": list(empty.matrix(part.column("text").to_pylist()))}

    keep = ("use", "draw", "doc_id", "toxic")
    got = map_rows(chosen.where("use != 'lexicon'").select(*keep, "text"), dense, "x array<double>", keep).collect()

    def table(use: str) -> tuple[np.ndarray, np.ndarray]:
        rows = sorted((r for r in got if r.use == use), key=lambda r: (r.draw, r.doc_id))
        return np.array([r.x for r in rows], float).reshape(len(rows), FEATURES), np.array([r.toxic for r in rows], float)

    x, y = table("trees")
    if not len(y):
        return empty
    trees = boosting.fit_trees(x, y, trees=80, depth=3, rate=0.15)
    x, y = table("calibration")
    raw = trees.probability(x)
    if not len(y):
        return Scorer(empty.lexicon, trees, (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    return Scorer(empty.lexicon, trees, boosting.fit_isotonic(raw, y))


def score_documents(docs: DataFrame, scorer: Scorer, keep=("doc_id",), names=("score", "predicted")) -> DataFrame:
    """score (0 to 1) and predicted (1 from 0.5) of every row, under names that no kept column has."""

    def run(part):
        score = scorer.score(part.column("text").to_pylist())
        return {names[0]: score, names[1]: (score >= 0.5).astype(np.int32)}

    return map_rows(docs.select(*dict.fromkeys([*keep, "text"])), run, f"{names[0]} double, {names[1]} int", keep)
