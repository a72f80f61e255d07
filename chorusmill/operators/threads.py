"""Reply trees of any depth: the depth and the root of every comment by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written


def reply_trees(rows: DataFrame) -> DataFrame:
    """(tree, node, parent, depth, root) for (tree, node, parent): node is unique within its tree.

    A node without a parent, or whose parent is no node of its tree, is a root of depth 0. Nodes of a cycle, and those that
    hang below one, have no depth and no root. Null nodes go. Every round doubles how far a node has looked, so a chain of n
    replies takes log2(n) rounds; each is a written table, and only nodes that have not reached a root take part.
    """
    nodes = rows.where("node IS NOT NULL").select("tree", "node", "parent")
    known = nodes.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"))
    met = nodes.join(known, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("parent") == F.col("_node")), "left")
    rooted = F.col("_node").isNull()
    # how far each node has looked: the node above, the steps to it, and whether that is a root
    look = met.select("tree", "node", "parent", F.coalesce("_node", "node").alias("above"), F.when(rooted, 0).otherwise(1).cast("long").alias("steps"), rooted.alias("arrived"))
    table = written(look, "threads")
    settled, open_ = table.where("arrived"), table.where("NOT arrived")
    while not open_.isEmpty():
        columns = [F.col(c).alias(f"_{c}") for c in ("tree", "node", "above", "steps", "arrived")]
        further = settled.unionByName(open_).select(*columns)
        moved = open_.join(further, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("above") == F.col("_node")))
        moved = written(moved.select("tree", "node", "parent", F.col("_above").alias("above"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_arrived").alias("arrived")), "threads")
        reached, open_ = moved.where("arrived"), moved.where("NOT arrived")
        if reached.isEmpty():
            break  # the lowest depth that is left arrives in every round, so these go round in cycles
        settled = settled.unionByName(reached)
    found = settled.select("tree", "node", "parent", F.col("steps").alias("depth"), F.col("above").alias("root"))
    lost = open_.select("tree", "node", "parent", F.lit(None).cast("long").alias("depth"), F.lit(None).cast(dict(rows.dtypes)["node"]).alias("root"))
    return found.unionByName(lost)


def comment_threads(rows: DataFrame) -> DataFrame:
    """reply_trees of comment rows with an id; of rows that share an id in a media the first by (ord, pos) counts."""
    named = rows.where("comment_id IS NOT NULL").groupBy(F.col("media_id").alias("tree"), F.col("comment_id").alias("node"))
    return reply_trees(named.agg(F.min_by("parent_comment_id", F.struct("ord", "pos")).alias("parent")))
