"""N-gram Jaccard self-join of documents with a MinHash LSH forest.

Texts are sets of five-word shingles. Equal texts are one text from the start (a hash of their words, counted with map-side
combination). Each tree of the forest orders texts by a run of LENGTH MinHashes; texts that share a prefix of it are a node of
its trie. Prefixes are matched at their whole length first. Within a node, leaders take in the texts that resemble them (by all
MinHashes), which gives families: a number of comparisons in proportion to the node. Families are then verified exactly: their texts meet in cells of two blocks, shingle
sets become sparse columns, one matrix product gives all intersections, and only counts and a spanning forest leave a cell.
The weakest link found says how surely the forest catches a link like it at this prefix length. While that is below the target,
prefixes are shortened to the longest length that reaches it. Of the nodes there, which are the parents in the tries, only those
go on that hold texts of different families: the others can bring no new link. Only families that grew are verified again.

Leaders: a text with an estimate of REMOVE or more is taken in for good, all texts from LINK on belong to the leader's group. By
the triangle inequality a partner (0.8) of a text taken in at 0.65 resembles the leader at 0.45, well above LINK. A node of more
than NODE_BLOCK texts is led block by block; its leaders then meet the texts of its other blocks, so that the same holds there.

Result per document: class_id (smallest doc_id of its class) and n_links (other documents at 0.8 or more, copies included).

Defined cases: NULL texts and texts without words have no class but their own and no links; texts of fewer than five words
are one shingle of all their words; repeated rows are copies; a NULL doc_id is a document like others, and a class of such
has a NULL class_id; ties do not arise. Very long texts are read whole; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vitrina.llm.common import map_rows, words
from vitrina.llm.components import components
from vitrina.sources.staging import stage_table

WORDS = 5
SIMILAR = 0.8
TREES, LENGTH, SHORTEST = 16, 6, 2
TARGET_RECALL = 0.995
REMOVE, LINK = 0.65, 0.3
NODE_BLOCK, CELL_BLOCK = 2048, 256
COLUMNS_AT_ONCE = 16_384
HASHED_AT_ONCE = 1024
_MIX = np.random.default_rng(20240229).integers(1, 2**63, (2, TREES * LENGTH, 1), dtype=np.uint64) | np.uint64(1)
_POSITION = np.random.default_rng(7).integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)


class _Hashes(dict):
    """Hash of every word looked up, computed once; emptied when it grows large."""

    def __missing__(self, word: str) -> int:
        self[word] = hashed = xxhash.xxh3_64_intdigest(word)
        return hashed


_SEEN = _Hashes()


def shingle_hashes(tokens: list[str]) -> np.ndarray:
    """64-bit hashes of the shingles in text order, repeats included; empty without words."""
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(" ".join(tokens))], np.uint64)
    if len(_SEEN) > 500_000:
        _SEEN.clear()
    hashed = np.fromiter(map(_SEEN.__getitem__, tokens), np.uint64, len(tokens))
    n = len(tokens) - WORDS + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(WORDS):
        part = hashed[k : k + n] * _POSITION[k]
        mixed += part ^ (part >> np.uint64(29))
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(31))


def shingles(tokens: list[str]) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(tokens))


def signature(sets: np.ndarray) -> np.ndarray:
    """One MinHash (32 bits) for each function, all functions at once over pieces of the set that stay in the cache."""
    out = np.full(TREES * LENGTH, np.iinfo(np.uint64).max)
    for start in range(0, len(sets), HASHED_AT_ONCE):
        hashed = sets[None, start : start + HASHED_AT_ONCE] * _MIX[0]
        hashed += _MIX[1]
        np.minimum(out, hashed.min(1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _sign(part) -> dict:
    keys, signs = [], []
    for text in part.column("text").to_pylist():
        tokens = words(text)
        keys.append(xxhash.xxh3_128_hexdigest(" ".join(tokens)) if tokens else None)
        signs.append(signature(shingle_hashes(tokens)).tobytes() if tokens else None)  # repeats leave a minimum as it is
    return {"text_key": keys, "signature": pa.array(signs, pa.binary())}


def _leaders(table: pa.Table) -> pa.Table:
    """Texts of a block of a node, each with the first leader of its group of leaders (a) and whether it leads itself.

    Leaders that are linked to a common text are one group, so there is one row for each text however many leaders there are.
    """
    table = table.sort_by("text_key")
    keys = table.column("text_key").to_pylist()
    signs = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(len(keys), -1)
    group, leads = np.full(len(keys), -1), np.zeros(len(keys), bool)
    left = np.arange(len(keys))
    while len(left):
        head = left[0]
        leads[head] = True
        likeness = (signs == signs[head]).mean(1)
        linked = np.flatnonzero(likeness >= LINK)
        met = np.unique(group[linked])
        met = met[met >= 0]
        first = met[0] if len(met) else head
        if len(met) > 1:
            group[np.isin(group, met)] = first
        group[linked] = first
        left = left[likeness[left] < REMOVE]
    return _grouped(table, keys, group, leads)


def _take_in(table: pa.Table) -> pa.Table:
    """Texts of a block of a node, linked to leaders from all blocks of that node; one row for each text and leader."""
    table = table.sort_by([("leads", "descending"), ("text_key", "ascending")])
    keys, leads = table.column("text_key").to_pylist(), table.column("leads").to_numpy()
    signs = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(len(keys), -1)
    group = np.arange(len(keys))
    for head in np.flatnonzero(leads):
        linked = np.flatnonzero((signs == signs[head]).mean(1) >= LINK)
        met = np.unique(group[linked])
        group[np.isin(group, met)] = met[0]
    return _grouped(table, keys, group, leads)


def _grouped(table: pa.Table, keys: list[str], group: np.ndarray, leads: np.ndarray) -> pa.Table:
    """node, a (first text of the group), b (the text), leads."""
    node = table.column("node")[0].as_py()
    columns = {"node": pa.array([node] * len(keys), pa.int64()), "a": [keys[k] for k in group], "b": keys, "leads": leads}
    return pa.table(columns)


def family_edges(texts: DataFrame, depth: int, families: DataFrame | None = None) -> DataFrame:
    """Edges between texts that share a node at this depth and resemble a leader of it. texts: text_key, signature.

    With families (node, root) known from longer prefixes, only of nodes that hold texts of different families.
    """

    def prefix(tree: int):
        start = 1 + 4 * tree * LENGTH
        return F.xxhash64(F.lit(tree), F.substr(F.col("signature"), F.lit(start), F.lit(4 * depth)))

    prefixes = F.explode(F.array(*[prefix(t) for t in range(TREES)])).alias("node")
    if families is None:
        nodes = texts.select("text_key", prefixes)
        shared = nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    else:
        rooted = texts.join(families.select(F.col("node").alias("text_key"), "root"), "text_key", "left")
        nodes = rooted.select("text_key", F.xxhash64(F.coalesce("root", "text_key")).alias("family"), prefixes)
        shared = nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("family").alias("low"), F.max("family").alias("high")).where("low < high")
    shared = shared.select(F.col("node").alias("shared"), "n")
    met = nodes.join(shared, (F.col("node") == F.col("shared")) & (F.hash("node") == F.hash("shared"))).select("node", "n", "text_key")
    blocks = F.ceil(F.col("n") / NODE_BLOCK).cast("int")
    met = met.select("node", "text_key", blocks.alias("blocks"), F.pmod(F.xxhash64("text_key"), blocks).alias("block"))
    signed = met.join(texts, "text_key").select("node", "block", "blocks", "text_key", "signature")
    schema = "node long, a string, b string, leads boolean"
    edges = stage_table(signed.groupBy("node", "block").applyInArrow(_leaders, schema))
    # In a node of several blocks, the leaders of all blocks meet the texts of all blocks, in cells of bounded size.
    split = met.where("blocks > 1")
    sizes = split.select(F.col("node").alias("split"), "blocks").distinct()
    heads = edges.where("leads").join(sizes, F.col("node") == F.col("split")).select("node", "blocks", F.col("b").alias("text_key"))
    chunks = heads.groupBy(F.col("node").alias("led")).agg(F.ceil(F.count("*") / NODE_BLOCK).cast("int").alias("chunks"))
    led = F.col("node") == F.col("led")
    heads = heads.join(chunks, led).select(
        "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("text_key"), "chunks").cast("int").alias("chunk"),
        "text_key", F.lit(True).alias("leads"),
    )
    members = split.join(chunks, led).select(
        "node", F.col("block").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        "text_key", F.lit(False).alias("leads"),
    )
    cells = heads.unionByName(members).join(texts, "text_key")
    more = cells.groupBy("node", "block", "chunk").applyInArrow(_take_in, schema)
    return edges.unionByName(more).where("a <> b").select("a", "b").distinct()


def caught(likeness, depth: int):
    """How surely the forest brings two texts of this similarity together in a node of this depth."""
    return 1 - (1 - likeness**depth) ** TREES


def next_depth(likeness: float, depth: int, target_recall: float) -> int:
    """The longest prefix, of this length or less, that catches such links as surely as asked."""
    return next((d for d in range(depth, SHORTEST, -1) if caught(likeness, d) >= target_recall), SHORTEST)


def _weakest(cells: DataFrame, depth: int) -> float:
    """The smallest similarity of the links of these cells, from how surely they were caught; 1 without links."""
    least = cells.where("n_texts > 0").agg(F.min(F.col("n_texts") / F.col("expected"))).first()[0]
    return 1.0 if least is None else (1 - (1 - min(least, 1.0)) ** (1 / TREES)) ** (1 / depth)


def _grown(families: DataFrame, edges: DataFrame) -> DataFrame | None:
    """node, root of the families that edges between texts of different ones make larger; None without any."""
    for side in ("a", "b"):
        known = families.select(F.col("node").alias("at"), F.col("root").alias("family"))
        met = (F.col(side) == F.col("at")) & (F.xxhash64(side) == F.xxhash64("at"))
        edges = edges.join(known, met, "left").withColumn(side, F.coalesce("family", side)).select("a", "b")
    joined = components(edges.where("a <> b").distinct())
    if joined.isEmpty():
        return None
    # One row for each family that others join, staged; the planner sees its size.
    moved = joined.select(F.col("node").alias("before"), F.col("root").alias("after"))
    members = families.join(moved, F.col("root") == F.col("before")).select("node", F.col("after").alias("root"))
    alone = joined.join(families.select("node"), "node", "left_anti")
    return stage_table(members.unionByName(alone))


def _verify(depth: int):
    def run(table: pa.Table) -> pa.Table:
        """Counts and a spanning forest of the links of one cell."""
        table = table.sort_by("text_key")
        keys, copies = table.column("text_key").to_pylist(), table.column("copies").to_numpy()
        first, second = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        keep = np.array([k == 0 or keys[k] != keys[k - 1] for k in range(len(keys))])  # repeated rows of one text
        at = np.flatnonzero(keep)
        keys, copies, block = [keys[k] for k in at], copies[at], table.column("block").to_numpy()[at]
        sets = [np.frombuffer(s, np.uint64) for s in (table.column("shingles")[int(k)].as_py() for k in at)]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[column] > 1
        renumbered = np.cumsum(times > 1) - 1
        owner, column = owner[shared], renumbered[column[shared]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        width = int((times > 1).sum())
        for start in range(0, width, COLUMNS_AT_ONCE):
            lo, hi = np.searchsorted(column, [start, start + COLUMNS_AT_ONCE])
            dense = np.zeros((len(sets), min(COLUMNS_AT_ONCE, width - start)), np.float32)
            dense[owner[lo:hi], column[lo:hi] - start] = 1
            common += dense @ dense.T
        common = common.astype(np.int64)
        union = sizes[:, None] + sizes[None, :] - common
        here = (block[:, None] == first) & (block[None, :] == second) if first != second else np.ones(common.shape, bool)
        here = here | here.T
        np.fill_diagonal(here, False)
        linked = here & (5 * common >= 4 * union)  # 0.8 in whole numbers
        likeness = common / np.maximum(union, 1)
        weakest = np.where(linked, likeness, 1).min(1)
        expected = linked.sum(1) / caught(weakest, depth)
        root = np.arange(len(keys))
        while True:  # smallest reachable number, within the cell
            near = np.where(linked, root[None, :], len(keys)).min(1, initial=len(keys))
            after = np.minimum(root, near)
            after = after[after]
            if (after == root).all():
                break
            root = after
        return pa.table({
            "text_key": keys, "n_texts": linked.sum(1), "n_documents": linked @ copies, "expected": expected,
            "root": [keys[r] for r in root],
        })

    return run


VERIFIED = "text_key string, n_texts long, n_documents long, expected double, root string"


def verify(docs: DataFrame, chosen: DataFrame, families: DataFrame, depth: int) -> DataFrame:
    """Partial counts of the texts of all cells. chosen: text_key, row_key, copies; families: node, root."""
    # Only families of several blocks are looked up: a small staged table, so that no family meets in one task for it.
    large = stage_table(families.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") > CELL_BLOCK))
    sized = families.join(large, "root", "left")
    blocks = F.coalesce(F.ceil(F.col("size") / CELL_BLOCK), F.lit(1)).cast("int")
    placed = sized.select(F.col("node").alias("text_key"), F.col("root").alias("family"), blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).alias("block"))
    wanted = chosen.join(placed, "text_key").withColumnRenamed("row_key", "wanted_key").drop("text_key")
    rows = docs.select("text", _row_key(docs).alias("row_key"))
    found = rows.join(wanted, (F.col("row_key") == F.col("wanted_key")) & (F.hash("row_key") == F.hash("wanted_key")))

    def sets(part):
        keys, out = [], []
        for text in part.column("text").to_pylist():
            tokens = words(text)
            keys.append(xxhash.xxh3_128_hexdigest(" ".join(tokens)))
            out.append(shingles(tokens).tobytes())
        return {"text_key": keys, "shingles": pa.array(out, pa.binary())}

    kept = ["copies", "family", "blocks", "block"]
    # Of rows that repeat each other, id included, one goes on; only texts with copies have such, so only these are shuffled.
    found = found.select("row_key", "text", *kept)
    found = found.where("copies = 1").unionByName(found.where("copies > 1").dropDuplicates(["row_key"]))
    shingled = map_rows(found.select("text", *kept), sets, "text_key string, shingles binary", kept)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = shingled.withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    return cells.groupBy("family", "i", "j").applyInArrow(_verify(depth), VERIFIED)


def _row_key(docs: DataFrame):
    return F.xxhash64("doc_id", "text")


def near_copies(docs: DataFrame, target_recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, row_key, class_id, class_key, n_links, n_similar_texts of every row. docs: doc_id, text."""
    docs = docs.select("doc_id", "text")
    signed = stage_table(map_rows(docs.withColumn("row_key", _row_key(docs)), _sign, "text_key string, signature binary", ["doc_id", "row_key"]))
    texts = stage_table(
        signed.where("text_key IS NOT NULL").groupBy("text_key")
        .agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.min("row_key").alias("row_key"), F.first("signature").alias("signature"))
    )
    depth, chosen, signatures = LENGTH, texts.select("text_key", "row_key", "copies"), texts.select("text_key", "signature")
    families = components(family_edges(signatures, depth))
    cells = stage_table(verify(docs, chosen, families, depth))
    likeness = _weakest(cells, depth)
    while (shorter := next_depth(likeness, depth, target_recall)) < depth:
        depth = shorter
        grown = _grown(families, family_edges(signatures, depth, families))
        if grown is None:
            break
        more = stage_table(verify(docs, chosen, grown, depth))
        likeness = min(likeness, _weakest(more, depth))
        cells = stage_table(cells.join(grown.select(F.col("node").alias("text_key")), "text_key", "left_anti").unionByName(more))
        families = stage_table(families.join(grown.select("node"), "node", "left_anti").unionByName(grown))
    linked = cells.groupBy("text_key").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_documents").alias("n_documents"))
    classes = components(cells.select(F.col("text_key").alias("a"), F.col("root").alias("b")))
    members = (
        texts.select("text_key", "copies", "first_id").join(classes.withColumnRenamed("node", "text_key"), "text_key", "left")
        .join(linked, "text_key", "left").withColumn("root", F.coalesce("root", "text_key"))
    )
    named = members.groupBy(F.col("root").alias("class_key")).agg(F.min("first_id").alias("class_id"))
    members = members.join(named, (F.col("root") == F.col("class_key")) & (F.xxhash64("root") == F.xxhash64("class_key"))).select(
        F.col("text_key").alias("member"), "class_key", "class_id",
        (F.coalesce("n_documents", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("n_texts", F.lit(0)).alias("n_similar_texts"),
    )
    members = stage_table(members)
    # Rows without words get keys of their own, so that they do not meet in one partition.
    own = F.concat(F.lit("-"), F.col("row_key").cast("string"))
    rows = signed.select("doc_id", "row_key", F.coalesce("text_key", own).alias("key"), F.col("text_key").isNull().alias("alone"))
    joined = rows.join(members, (F.col("key") == F.col("member")) & (F.xxhash64("key") == F.xxhash64("member")), "left")
    return joined.select(
        "doc_id", "row_key", F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_key", "key").alias("class_key"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_similar_texts", F.lit(0)).alias("n_similar_texts"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, of each class only the one with the smallest id (NULL ids last); documents without words all stay."""
    grouped = stage_table(near_copies(docs))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row_key"))
    alone = F.startswith(F.col("class_key"), F.lit("-"))
    kept = grouped.where(~alone).groupBy("class_key").agg(F.min(first).alias("first")).select(F.col("first.row_key").alias("__kept_key"))
    kept = stage_table(kept.unionByName(grouped.where(alone).select(F.col("row_key").alias("__kept_key"))).distinct())
    empty = F.coalesce(F.length(F.regexp_replace("text", r"(?U)\W+", "")) == 0, F.lit(True))
    rows = docs.withColumn("__row_key", _row_key(docs))
    rows = rows.join(kept, (F.col("__row_key") == F.col("__kept_key")) & (F.hash("__row_key") == F.hash("__kept_key")), "left_semi")
    repeated = grouped.where(~alone).groupBy("row_key").count().where("count > 1").select("row_key")
    if not repeated.limit(1).count():
        return rows.drop("__row_key")
    # Rows that repeat a document word for word, id included: one of them stays.
    once = rows.where(~empty).dropDuplicates(["__row_key"])
    return once.unionByName(rows.where(empty)).drop("__row_key")
