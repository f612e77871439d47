"""Connected components by contraction: the core's own way, for groups, clusters and persons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.shared import materialize, release


def _roots(hooks: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, up): paths are halved until every node points to a root, in log2(depth) joins."""
    at = materialize(hooks.select("node", F.col("up").alias("root")), "hooks")
    while True:
        above = at.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = materialize(at.join(above, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "jumps")
        release(at)
        at = jumped
        if at.where("moved").isEmpty():
            return at.select("node", "root")


def component_labels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the least node linked to each node of ``edges``, directly or not.

    Each turn every node that has a lesser neighbour hooks on to its least one, the trees are flattened, and the edges are
    rewritten to run between roots.  A root is less than all its neighbours, so no two are adjacent; roots that are no
    one's least neighbour hook on in the next turn.  Two turns leave at most half of the nodes of each component, in whatever order
    a chain is named: about 2 log2 n turns at most, and each is smaller than the one before.

    Pairs may repeat, stand in either order or link a node to itself; pairs with a null are no links.  An
    empty table gives an empty table.  Each turn is written to the shared folder; a hub's edges are reduced before they are shuffled.
    """
    every = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    every = materialize(every.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "links")
    live, labels = every.where("u > v"), None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("up")).where("up < node")
        turn = _roots(hooks)
        of = lambda side: turn.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        moved = live.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_root", "u").alias("x"), F.coalesce("v_root", "v").alias("y")).where("x <> y")
        contracted = materialize(moved.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "contracted")
        if live is not every:
            release(live)
        live = contracted
        # Nodes that hooked on earlier follow their root.
        earlier = None if labels is None else labels.join(turn.select(F.col("node").alias("label"), "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
        now = turn.select("node", F.col("root").alias("label"))
        labels, old = materialize(now if earlier is None else now.unionByName(earlier), "labels"), labels
        release(old)
    nodes = every.select(F.col("u").alias("node")).unionByName(every.select(F.col("v").alias("node"))).distinct()
    if labels is None:
        return nodes.select("node", F.col("node").alias("label"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
