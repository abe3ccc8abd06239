"""Consolidating pairwise matches into groups (problem 1).

Connected components by alternating large-star and small-star rewrites of the
edges: every rewrite is an aggregation and a join, and each round's edges are
written to the shared folder. At the end all edges of a component point from a
member to its smallest identifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.plans.runtime import counting_rows, materialize, read_table, release


def star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star over edges (v, u) with v > u; moved marks changes.

    Large-star ties each larger neighbour of a node to the smallest one of its
    neighbours and itself; small-star ties a node's smaller neighbours and the
    node to the smallest of them. The minima are aggregated before they are
    shuffled; a node with very many edges is split by the adaptive skew join.
    """
    least = edges.select(F.col("u").alias("n"), F.lit(None).cast("bigint").alias("m")).union(edges.select(F.col("v"), F.col("u")))
    low = least.groupBy("n").agg(F.least(F.col("n"), F.min("m")).alias("m"))
    large = edges.join(low, F.col("u") == F.col("n")).select("v", F.col("m").alias("u"), (F.col("m") != F.col("n")).alias("moved"))
    down = large.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("m"), F.max("moved").alias("any"))
    across = large.join(down, F.col("v") == F.col("n")).where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"), F.lit(True).alias("moved"))
    return across.union(down.select("n", "m", "any")).groupBy("v", "u").agg(F.max("moved").alias("moved"))


def connected_components(pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node and component, the smallest node linked to it directly or indirectly.

    pairs has a and b (bigint), in any order, repeated or not; a pair with a
    null, or of a node with itself, links nothing. nodes has node; nodes that
    are in no pair form components of their own. Both may be empty; other
    columns are ignored. Rounds go on until no edge moves: their number is
    logarithmic in the length of the longest chain.
    """
    edges = pairs.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("a is not null and b is not null and a <> b").distinct()
    edges = materialize(edges, "edges")
    while True:
        turned = materialize(star_round(edges), "edges")
        release(edges)
        edges = turned
        if not edges.agg(F.max("moved")).first()[0]:
            break
    linked = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    own = edges.select(F.col("u").alias("node"))
    if nodes is not None:
        own = own.union(nodes.select("node").where("node is not null"))
    rest = own.distinct().join(linked.select("node"), "node", "left_anti")
    return linked.unionByName(rest.withColumn("component", F.col("node")))


def confirmed(groups: DataFrame) -> DataFrame:
    """Counting rows of candidate_groups that were found to be duplicates."""
    return counting_rows(groups.select("group_id", "notes", "pairs", "is_duplicate", "verified_at"), "group_id", "verified_at").where("is_duplicate")


def p1_found(spark, sf_dir: str) -> DataFrame:
    g = materialize(confirmed(read_table(spark, sf_dir, "candidate_groups")).select("notes", "pairs"), "groups")
    pairs = g.select(F.inline("pairs")).select("a", "b")
    nodes = g.select(F.explode("notes").alias("node")).union(pairs.select("a")).union(pairs.select("b"))
    return connected_components(pairs, nodes).select(F.col("node").alias("note_id"), F.col("component").alias("component_id"))
