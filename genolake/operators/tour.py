"""Euler tour of a tree: what lies below a node is a range of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genolake.plans.scratch import cut_lineage


def euler_tour(tree_nodes: DataFrame) -> DataFrame:
    """(node_id, parent_id, enter, exit, depth, leaves) of tree_nodes(node_id, parent_id, preorder).

    Nodes below v (v itself included) are those whose enter is in [enter, exit) of v; enter goes from 0 in depth-first order,
    children by preorder, then node_id; leaves: how many of them have no child. The tour enters and leaves each node once. It is
    a list of twice the nodes, ranked by doubling: each round every place adds the sums of the place it points to and points
    on to where that one points. So memory grows with the nodes and rounds with their logarithm, whatever the depth. Nodes that no
    root leads to (a circle of parents, an unknown parent) are an error.
    """
    nodes = tree_nodes.select("node_id", "parent_id", "preorder")
    order = Window.partitionBy("parent_id").orderBy("preorder", "node_id")
    nodes = nodes.withColumn("sibling", F.lead("node_id").over(order)).withColumn("no", F.row_number().over(order))
    first = nodes.where("no = 1 and parent_id is not null").select(F.col("parent_id").alias("node_id"), F.col("node_id").alias("child"))
    nodes = nodes.join(first, "node_id", "left")
    down = nodes.select("node_id", F.lit(0).alias("side"), F.coalesce("child", "node_id").alias("to"), F.when(F.col("child").isNull(), 1).otherwise(0).alias("to_side"), F.lit(1).alias("n"), F.lit(1).alias("net"), F.col("child").isNull().cast("int").alias("leaves"))
    up = nodes.select("node_id", F.lit(1).alias("side"), F.coalesce("sibling", "parent_id").alias("to"), F.when(F.col("sibling").isNull(), 1).otherwise(0).alias("to_side"), F.lit(0).alias("n"), F.lit(-1).alias("net"), F.lit(0).alias("leaves"))
    sums = ["n", "net", "leaves"]
    at = down.union(up).select("node_id", "side", "to", "to_side", *[F.col(c).cast("long").alias(c) for c in sums])
    at = cut_lineage(at)
    size, reach = at.count(), 1

    def doubled(x: DataFrame) -> DataFrame:
        then = x.select(F.col("node_id").alias("to"), F.col("side").alias("to_side"), F.col("to").alias("_to"), F.col("to_side").alias("_side"), *[F.col(c).alias(f"_{c}") for c in sums])
        j = x.join(then, ["to", "to_side"], "left")
        return j.select("node_id", "side", F.col("_to").alias("to"), F.col("_side").alias("to_side"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums])

    while reach < size:  # two doublings for each table written
        at, reach = cut_lineage(doubled(doubled(at))), 4 * reach
    open_, most = at.agg(F.count("to"), F.coalesce(F.max("n"), F.lit(0))).first()
    if open_ or 2 * most != size:  # places that never end, or a list beside that of the roots
        raise ValueError("the tree has a circle of parents, or an unknown parent")
    by_side = [at.where(F.col("side") == s).select("node_id", *[F.col(c).alias(f"{c}{s}") for c in sums]) for s in (0, 1)]
    total = F.lit(size // 2)
    out = tree_nodes.select("node_id", "parent_id").join(by_side[0], "node_id").join(by_side[1], "node_id")
    out = out.select("node_id", "parent_id", (total - F.col("n0")).alias("enter"), (total - F.col("n1")).alias("exit"), (-F.col("net0")).alias("depth"), (F.col("leaves0") - F.col("leaves1")).alias("leaves"))
    return cut_lineage(out)


def last_on_path(changes: DataFrame, tour: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(node_id, keys, value): for each node and key the last change on its path from the root. A change holds for the range
    of numbers below its node; of the ranges around a number the one that begins last is the innermost."""
    spread = changes.join(tour.select("node_id", "enter", "exit"), "node_id").select(*keys, value, F.col("enter").alias("_since"), F.explode(F.sequence("enter", F.col("exit") - 1)).alias("enter"))
    last = spread.groupBy(*keys, "enter").agg(F.max_by(value, "_since").alias(value))
    return last.join(tour.select("node_id", "enter"), "enter").select("node_id", *keys, value)
