"""Connected components by distributed minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.plans.lineage import cut


def leaves(links: DataFrame) -> DataFrame:
    """id, hub: the nodes with one neighbour, and that; of two nodes with no others, the greater. ``links`` has both directions as a and b, no loops."""
    one = links.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("_b")).where("b = _b")
    x, y = F.least("a", "b"), F.greatest("a", "b")
    each = one.groupBy(x.alias("_x"), y.alias("_y")).agg(F.count("*").alias("_n"), F.max("a").alias("id"))
    return each.select("id", F.when(F.col("id") == F.col("_x"), F.col("_y")).otherwise(F.col("_x")).alias("hub"))


def without(links: DataFrame, leaf: DataFrame) -> DataFrame:
    """The links that end in no leaf."""
    for end in ("a", "b"):
        links = links.join(leaf.select(F.col("id").alias(end)), end, "left_anti")
    return links


def components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """Label every node that occurs in ``edges`` with the least node it is connected to.

    Returns ``node, component``. Null endpoints are ignored, repeated edges and
    self-loops change nothing, and no edges give no rows. Each round shuffles
    the edges once and the labels twice; labels, edges and intermediate state
    stay in Spark. A round takes, for each node, the least label among its
    neighbours and then the label of that label, so paths halve and stars end
    in one step. Rounds end when no label changes; ``max_rounds`` guards against
    a loop that does not end and raises if it is reached. Nodes with one
    neighbour take no part in the rounds: they have that one's label.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null and a <> b")
    every = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    loops = edges.where(f"`{left}` = `{right}`").select(F.col(left).alias("node"), F.col(left).alias("component"))
    if every.isEmpty():
        return loops.distinct()
    leaf = cut(leaves(every))
    both = cut(without(every, leaf))
    # A label is the least of its inner nodes; leaves may be less.
    inner = _labels(both, max_rounds)
    hub = leaf.groupBy("hub").agg(F.min("id").alias("_low"))
    at = inner.join(hub.withColumnRenamed("hub", "node"), "node", "full").select("node", F.coalesce("component", "node").alias("_c"), F.least("node", "_low").alias("_low"))
    low = at.groupBy("_c").agg(F.min("_low").alias("component"))
    at = cut(at.join(low, "_c").select("node", "component"))
    outer = leaf.join(at.withColumnRenamed("node", "hub"), "hub").select(F.col("id").alias("node"), "component")
    return at.unionByName(outer).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))


def _labels(both: DataFrame, max_rounds: int) -> DataFrame:
    """node, component of links in both directions."""
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    label = cut(label)
    for _ in range(max_rounds):
        # The least label among neighbours, pre-aggregated before the shuffle.
        near = both.join(label, both.b == label.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = label.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        jump = label.select(F.col("node").alias("next"), F.col("component").alias("beyond"))
        moved = cut(
            step.join(jump, "next", "left").select(
                "node", F.least("next", F.coalesce("beyond", "next")).alias("label"), F.col("component").alias("before")
            )
        )
        label = moved.select("node", F.col("label").alias("component"))
        if moved.where("label <> before").isEmpty():
            return label
    raise RuntimeError(f"labels still move after {max_rounds} rounds")
