"""Connected components of similarity edges and the groups assembled from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.plans.runtime import materialize, release

MAX_GROUP = 4


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reached) of edges (a, b).

    In a round each node points to its smallest neighbour, if that is smaller,
    and pointers are doubled until they end at nodes that point nowhere. These
    stand for their trees in the next round, with the edges that are left
    between different ones, so that all edges are gone through about once. At
    least half of the nodes that have edges are gone after each round.
    """
    e = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    out = None
    while True:
        both = e.union(e.select("b", "a"))
        label = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")).withColumn("moved", F.lit(True)), "labels")
        while label.agg(F.max("moved")).first()[0]:
            up = label.select(F.col("node").alias("root"), F.col("root").alias("grand"))
            turned = materialize(label.drop("moved").join(up, "root").select("node", F.col("grand").alias("root"), (F.col("grand") != F.col("root")).alias("moved")), "labels")
            release(label)
            label = turned
        to = lambda c: label.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        if out is None:
            out = label.select("node", "root")
        else:
            later = materialize(out.join(to("root"), "root", "left").select("node", F.coalesce("root_root", "root").alias("root")), "components")
            release(out)
            out = later
        left = e.join(to("a"), "a").join(to("b"), "b").where("root_a <> root_b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct()
        e, done = materialize(left, "edges"), e
        release(done)
        if e.isEmpty():
            return out


def candidate_groups(pairs: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """group_key, a, b, score of pairs grouped for review.

    Small components stay whole; a component of more than max_group nodes is
    split into its pairs, each a group of its own. group_key is the root, or
    root:a:b for a split pair, so keys are stable without any global order.
    """
    roots = components(pairs.select("a", "b"))
    size = roots.groupBy("root").agg(F.count("*").alias("nodes"))
    p = pairs.join(roots, F.col("a") == F.col("node")).join(size, "root")
    key = F.when(F.col("nodes") <= max_group, F.col("root").cast("string")).otherwise(F.concat_ws(":", "root", "a", "b"))
    return p.select(key.alias("group_key"), "a", "b", "score")


def group_strength(groups: DataFrame) -> DataFrame:
    """group_key, its number of pairs and its best score."""
    return groups.groupBy("group_key").agg(F.count("*").alias("pairs"), F.max("score").alias("best"))
