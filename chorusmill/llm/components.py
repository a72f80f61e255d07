"""Connected components of a link table, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_table, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b) that is not the least of its component; root is that least node.

    Each round every node with a lower neighbour hooks onto the least one, chains are shortened by doubling,
    and links between roots remain for the next round. Self-links, repeated links and nulls are ignored; an
    empty table gives no rows. A node with very many links costs one row per link and is never collected.
    """
    edges = materialize(links.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        hooks = _shortened(edges.groupBy("hi").agg(F.min("lo").alias("up")))
        ups = hooks.select(F.col("hi").alias("root"), "up")
        fresh = hooks.select(F.col("hi").alias("node"), F.col("up").alias("root"))
        if labels is None:
            labels = materialize(fresh, "labels")
        else:
            moved = labels.join(ups, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
            before, labels = labels, materialize(moved.unionByName(fresh), "labels")
            delete_table(before)
        lo, hi = ups.select(F.col("root").alias("lo"), F.col("up").alias("lo_up")), ups.select(F.col("root").alias("hi"), F.col("up").alias("hi_up"))
        x = edges.join(lo, "lo", "left").join(hi, "hi", "left").select(F.coalesce("lo_up", "lo").alias("a"), F.coalesce("hi_up", "hi").alias("b"))
        last, edges = edges, materialize(x.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")
        delete_table(last)
    if labels is None:
        return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return labels


def _shortened(hooks: DataFrame) -> DataFrame:
    """Replace each target by its own target until all targets are roots; the chain length halves each time."""
    hooks = materialize(hooks, "hooks")
    while True:
        further = hooks.select(F.col("hi").alias("up"), F.col("up").alias("next"))
        if hooks.join(further, "up", "left_semi").isEmpty():
            return hooks
        before, hooks = hooks, materialize(hooks.join(further, "up", "left").select("hi", F.coalesce("next", "up").alias("up")), "hooks")
        delete_table(before)
