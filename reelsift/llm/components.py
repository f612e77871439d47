"""Pairwise matches consolidated into groups: alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.shared import materialize, release


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node u links its neighbours greater than u to the least of u and its neighbours."""
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node u links itself and its neighbours less than u to the least of those (edges have u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _with_leaves(edges: DataFrame) -> DataFrame:
    """Edges (u > v, distinct) with ``leaf``: u has no other edge.  Written to the shared folder."""
    ends = _both_ways(edges).groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("u", F.lit(True).alias("leaf"))
    return materialize(edges.join(ends, "u", "left").select("u", "v", F.coalesce("leaf", F.lit(False)).alias("leaf")), "stars")


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of ``pairs`` the least node that it is linked to, directly or not.

    Nodes are of any ordered type.  Pairs may repeat, stand in either order or link a node to itself; a node
    that is linked only to itself is its own component.  Pairs with a null are no links.  An empty table gives an
    empty table.

    A node whose only neighbour is less than itself has that one's component, whatever comes: its edge is put aside, before the first round and
    after each.  So stars, which both steps leave as they are, vanish at once; rounds go on over what is left until no edge
    is.  Each is written to the shared folder, and the edges put aside are followed back from the last round to the first.
    A hub's edges are spread: least neighbours are pre-aggregated, and Spark splits the hub's rows in the join.
    """
    pairs = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    every = materialize(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "pairs")
    alone, edges, aside = every.where("u = v").select(F.col("u").alias("node")), every.where("u > v"), []
    while True:
        stars = _with_leaves(edges)
        aside.append(stars)
        if aside[1:]:
            release(edges)
        rest = stars.where("NOT leaf").select("u", "v")
        if rest.isEmpty():
            break
        edges = materialize(_small_star(_large_star(rest)).distinct(), "edges")
    members = None
    for done in reversed(aside):
        leaves = done.where("leaf").select(F.col("u").alias("node"), F.col("v").alias("up"))
        if members is None:
            members = leaves.withColumnRenamed("up", "component")
        else:
            found = leaves.join(members.select(F.col("node").alias("up"), "component"), "up", "left").select("node", F.coalesce("component", "up").alias("component"))
            members = materialize(found.unionByName(members), "members")
    for done in aside[:-1]:
        release(done)
    roots = members.select(F.col("component").alias("node")).distinct()
    members = members.unionByName(roots.select("node", F.col("node").alias("component")))
    return members.unionByName(alone.join(members.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
