"""Connected components of an edge table, by smallest labels and pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vitrina.sources.staging import stage_table


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node that occurs in edges (a, b).

    Hot nodes are no problem: minima combine before their shuffles, and adaptive execution splits the joins.
    """
    both = edges.select("a", "b").where("a <> b")
    both = stage_table(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stage_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
    while True:
        seen = both.join(labels, (F.col("b") == F.col("node")) & (F.xxhash64("b") == F.xxhash64("node"))).select("a", F.col("root").alias("near"))
        best = seen.groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        stepped = labels.join(best, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        target = labels.select(F.col("node").alias("at"), F.col("root").alias("further"))
        jumped = stepped.join(target, (F.col("root") == F.col("at")) & (F.xxhash64("root") == F.xxhash64("at")))
        after = stage_table(jumped.select("node", "old", F.least("root", "further").alias("root")))
        labels = after.select("node", "root")
        if not after.where("root <> old").limit(1).count():
            return labels
