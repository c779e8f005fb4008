"""Community detection: greedy heaviest-neighbour passes, Leiden, and a two-level hierarchy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.components import components, leaves, without
from loomspan.operators.graph import both_ways, damped
from loomspan.operators.relational import numbered

MAX_NODES, MAX_EDGES = 100_000, 200_000
#: Components of fewer nodes are one community.
WHOLE = 20


def greedy_labels(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, passes: int = 20) -> np.ndarray:
    """Each node in order joins the other community of its heaviest links; ties to the smaller one. Nodes are 0 .. n - 1."""
    order = np.argsort(a, kind="stable")
    a, b, w = a[order], b[order], w[order]
    first = np.searchsorted(a, np.arange(n + 1))
    label = np.arange(n)
    for _ in range(passes):
        moved = False
        for i in range(n):
            near = slice(first[i], first[i + 1])
            kinds, where = np.unique(label[b[near]], return_inverse=True)
            if not len(kinds):
                continue
            sums = np.bincount(where, w[near])
            sums[kinds == label[i]] = 0
            k = int(sums.argmax())
            if sums[k] > 0:
                label[i] = kinds[k]
                moved = True
        if not moved:
            break
    return label


def modularity_labels(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float = 1.0, rounds: int = 10) -> np.ndarray:
    """Leiden: local moves by modularity gain, refinement into connected parts, aggregation, until nothing moves."""
    total = w.sum()
    if not n or total <= 0:
        return np.arange(n)
    part = np.arange(n)  # of original nodes, as nodes of the present graph
    size, x, y, z = n, a, b, w
    for _ in range(rounds):
        label = _local_moves(size, x, y, z, total, resolution)
        refined = _connected_parts(size, x, y, label)
        kinds, refined = np.unique(refined, return_inverse=True)
        part = refined[part]
        if len(kinds) == size:
            break
        key = refined[x] * len(kinds) + refined[y]
        pairs, where = np.unique(key, return_inverse=True)
        z = np.bincount(where, z)
        x, y, size = pairs // len(kinds), pairs % len(kinds), len(kinds)
    return part


def _local_moves(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, total: float, resolution: float, passes: int = 10) -> np.ndarray:
    order = np.argsort(a, kind="stable")
    a, b, w = a[order], b[order], w[order]
    first = np.searchsorted(a, np.arange(n + 1))
    strength = np.bincount(a, w, n)
    label, weight = np.arange(n), strength.copy()
    for _ in range(passes):
        moved = False
        for i in range(n):
            near = slice(first[i], first[i + 1])
            other = b[near] != i
            kinds, where = np.unique(label[b[near]][other], return_inverse=True)
            if not len(kinds):
                continue
            own = label[i]
            weight[own] -= strength[i]
            links = np.bincount(where, w[near][other])
            gain = links - resolution * strength[i] * weight[kinds] / total
            stay = links[kinds == own].sum() - resolution * strength[i] * weight[own] / total
            k = int(gain.argmax())
            if gain[k] > stay + 1e-12:
                label[i] = kinds[k]
                moved = True
            weight[label[i]] += strength[i]
        if not moved:
            break
    return label


def _connected_parts(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Each community's connected parts, named by their least node."""
    inside = label[a] == label[b]
    x, y = a[inside], b[inside]
    out = np.arange(n)
    while True:
        least = out.copy()
        np.minimum.at(least, x, out[y])
        least = least[least]
        if (least == out).all():
            return out
        out = least


def modularity(edges: DataFrame, members: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row, modularity: the sum over communities of inner / 2m - resolution * (total / 2m) squared."""
    links = both_ways(edges, "weight")
    c = members.select("id", "community")
    both = links.join(c.withColumnsRenamed({"id": "a", "community": "ca"}), "a").join(c.withColumnsRenamed({"id": "b", "community": "cb"}), "b")
    each = both.groupBy("ca").agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inner"))
    m2 = F.sum("tot").over(Window.partitionBy(F.lit(1)))
    return each.withColumn("m2", m2).agg(F.round(F.sum(F.col("inner") / F.col("m2") - resolution * (F.col("tot") / F.col("m2")) ** 2), 6).alias("modularity"))


def _per_component(nodes: DataFrame, links: DataFrame, method: str, resolution: float) -> DataFrame:
    """id, component, local label: one call for each component of the graph."""
    own = nodes.select("id", "component")
    rows = own.select("component", "id", F.lit(None).cast("string").alias("other"), F.lit(0.0).alias("w")).unionByName(
        links.join(own.withColumnRenamed("id", "a"), "a").select("component", F.col("a").alias("id"), F.col("b").alias("other"), "w")
    )

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(frame["id"].unique())
        links_ = frame[frame["other"].notna()]
        a, b = np.searchsorted(ids, links_["id"].to_numpy()), np.searchsorted(ids, links_["other"].to_numpy())
        w = links_["w"].to_numpy(float)
        found = greedy_labels(len(ids), a, b, w) if method == "greedy" else modularity_labels(len(ids), a, b, w, resolution)
        names = pd.Series(ids).groupby(found).transform("min")
        return pd.DataFrame({"component": frame["component"].iloc[0], "id": ids, "label": names})

    return rows.groupBy("component").applyInPandas(run, "component string, id string, label string")


def _round(links: DataFrame, state: DataFrame, resolution: float, turn: int) -> DataFrame:
    """state after one round of moves: id, k, m2, label, and before, the label until now.

    Half of the nodes, another one each round, wish for the neighbouring label
    of the largest gain in modularity. Of neighbours that wish for a move only
    the one with the largest hash moves, so no two neighbours move at once.
    """
    weights = links.join(state.select(F.col("id").alias("b"), "label"), "b").groupBy("a", "label").agg(F.sum("w").alias("w"))
    weight = state.groupBy("label").agg(F.sum("k").alias("tot"))
    half = F.pmod(F.xxhash64("id", F.lit(turn // 2)), F.lit(2)) == turn % 2
    own = state.where(half).select(F.col("id").alias("a"), "k", "m2", F.col("label").alias("own"))
    near = weights.join(own, "a").join(weight, "label")
    cost = F.lit(resolution) * F.col("k") * (F.col("tot") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0.0)) / F.col("m2")
    each = near.withColumn("gain", F.col("w") - cost)
    best = each.groupBy("a").agg(
        F.max(F.when(F.col("label") != F.col("own"), F.struct("gain", "label"))).alias("best"), F.max(F.when(F.col("label") == F.col("own"), F.col("gain"))).alias("stay"), F.first("own").alias("own"), F.first("k").alias("k"), F.first("m2").alias("m2")
    )
    # A label that no neighbour has weighs all the same.
    alone = best.join(weight.withColumnsRenamed({"label": "own", "tot": "_tot"}), "own")
    stay = F.coalesce("stay", -F.lit(resolution) * F.col("k") * (F.col("_tot") - F.col("k")) / F.col("m2"))
    wish = alone.where(F.col("best.gain") > stay + 1e-12).select("a", F.col("best.label").alias("next"), F.xxhash64("a", F.lit(-turn)).alias("turn"))
    rival = links.where("a <> b").join(wish.select(F.col("a").alias("b"), F.col("turn").alias("_t")), "b").groupBy("a").agg(F.max(F.struct("_t", F.col("b").alias("a"))).alias("rival"))
    free = wish.join(rival, "a", "left").where(F.col("rival").isNull() | (F.struct("turn", "a") > F.struct(F.col("rival._t"), F.col("rival.a")))).select(F.col("a").alias("id"), "next")
    return state.drop("before").join(free, "id", "left").select("id", "k", "m2", F.coalesce("next", "label").alias("label"), F.col("label").alias("before"))


def _settled(links: DataFrame, state: DataFrame, resolution: float, rounds: int) -> DataFrame:
    """state after rounds of moves, until fewer than one node in a thousand moves in both halves."""
    from loomspan.plans.lineage import fresh

    nodes, quiet = state.count(), 0
    for turn in range(2 * rounds):
        state = fresh(_round(links, state, resolution, turn))
        moves = state.where("label <> before").count()
        quiet = quiet + 1 if 1000 * moves <= nodes else 0
        if quiet == 2:
            break
    return state


def _parts(links: DataFrame, state: DataFrame) -> DataFrame:
    """id, part: the connected parts of each label's nodes, named by their least node."""
    label = state.select("id", "label")
    inner = links.join(label.withColumnsRenamed({"id": "a", "label": "la"}), "a").join(label.withColumnsRenamed({"id": "b", "label": "lb"}), "b").where("la = lb").select("a", "b")
    return state.select("id").join(components(inner).withColumnsRenamed({"node": "id", "component": "part"}), "id", "left").select("id", F.coalesce("part", "id").alias("part"))


def moved_labels(own: DataFrame, links: DataFrame, method: str = "leiden", resolution: float = 1.0, rounds: int = 10, levels: int = 10, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> DataFrame:
    """id, label by rounds of distributed moves, for components of any size.

    ``own`` has id and component, ``links`` both directions as a, b, w. In a
    round nodes move to the neighbouring label of the largest gain, never two
    neighbours at once. ``greedy`` weighs links alone and ends with the rounds.
    ``leiden`` weighs them against chance within the component, splits labels
    into connected parts, contracts these to nodes and goes on with that graph,
    until nothing contracts; once a component's contracted graph is within the
    bounds, one task does its last levels by ``modularity_labels``. Each round
    shuffles the links of the present level; only counts reach the driver.
    Nodes without links keep their own label. No rows give no rows.

    A node with one neighbour takes no part in the rounds and has that one's
    label: no other is better for it by weight, nor, at a resolution of up to 1,
    by modularity.
    """
    from loomspan.plans.lineage import fresh

    strength = links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k"))
    state = own.select("id", "component").join(strength, "id", "left").na.fill(0.0, ["k"])
    total = state.groupBy("component").agg(F.sum("k").alias("m2"))
    state = fresh(state.join(total, "component").select("id", "component", "k", "m2"))
    part = state.select("id", F.col("id").alias("part"))
    near = links.where("a <> b")
    if method == "greedy" or resolution <= 1:
        leaf = fresh(leaves(near))
        held = near.join(leaf.select(F.col("id").alias("a"), "hub"), "a").groupBy("hub").agg(F.sum("w").alias("w")).select(F.col("hub").alias("a"), F.col("hub").alias("b"), "w")
        near = fresh(without(near, leaf).unionByName(held) if method == "greedy" else without(near, leaf))
        part = fresh(state.select("id").join(leaf, "id", "left").select("id", F.coalesce("hub", "id").alias("part")))
        state = fresh(state.join(part, "id").groupBy(F.col("part").alias("id")).agg(F.first("component").alias("component"), F.sum("k").alias("k"), F.first("m2").alias("m2")))
    if method == "greedy":
        # Leaves hold their hub, as a link of the hub to itself: it counts for the label that the hub has.
        found = _settled(near, state.select("id", "k", "m2", F.col("id").alias("label")), 0.0, rounds).select(F.col("id").alias("part"), "label")
        return part.join(found, "part").select("id", "label")
    done = None
    for _ in range(levels):
        moved = _settled(near, state.select("id", "k", "m2", F.col("id").alias("label")), resolution, rounds)
        refined = fresh(_parts(near, moved))
        part = fresh(part.join(refined.select(F.col("id").alias("part"), F.col("part").alias("_next")), "part").select("id", F.col("_next").alias("part")))
        size = state.count()
        state = fresh(state.join(refined, "id").groupBy(F.col("part").alias("id")).agg(F.first("component").alias("component"), F.sum("k").alias("k"), F.first("m2").alias("m2")))
        ends = near.join(refined.withColumnsRenamed({"id": "a", "part": "_a"}), "a").join(refined.withColumnsRenamed({"id": "b", "part": "_b"}), "b")
        near = fresh(ends.where("_a <> _b").groupBy(F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.sum("w").alias("w")))
        # Components whose contracted graph one task can take leave the rounds.
        load = state.groupBy("component").agg(F.count("*").alias("n")).join(near.join(state.select(F.col("id").alias("a"), "component"), "a").groupBy("component").agg(F.count("*").alias("e")), "component", "left")
        small = fresh(load.where((F.col("n") <= max_nodes) & (F.coalesce("e", F.lit(0)) <= 2 * max_edges)).select("component"))
        last = state.join(small, "component", "left_semi")
        if not small.isEmpty():
            found = fresh(_last_levels(last, near, resolution))
            done = found if done is None else done.unionByName(found)
            near = fresh(near.join(last.select(F.col("id").alias("a")), "a", "left_anti"))
            state = fresh(state.join(small, "component", "left_anti"))
        left = state.count()
        if not left or left == size:
            break
    rest = state.select(F.col("id").alias("part"), F.col("id").alias("label"))
    labels = rest if done is None else rest.unionByName(done)
    return part.join(labels, "part").select("id", "label")


def _last_levels(nodes: DataFrame, links: DataFrame, resolution: float) -> DataFrame:
    """part, label of contracted components, one call each; what a node holds inside is a link to itself."""
    outside = links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("_out"))
    loops = nodes.join(outside, "id", "left").select("component", F.col("id").alias("a"), F.col("id").alias("b"), (F.col("k") - F.coalesce("_out", F.lit(0.0))).alias("w"))
    rows = loops.unionByName(links.join(nodes.select(F.col("id").alias("a"), "component"), "a").select("component", "a", "b", "w"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(frame["a"].unique())
        a, b = np.searchsorted(ids, frame["a"].to_numpy()), np.searchsorted(ids, frame["b"].to_numpy())
        found = modularity_labels(len(ids), a, b, frame["w"].to_numpy(float), resolution)
        return pd.DataFrame({"part": ids, "label": pd.Series(ids).groupby(found).transform("min")})

    return rows.groupBy("component").applyInPandas(run, "part string, label string")


def propagate(nodes: DataFrame, links: DataFrame, rounds: int = 10) -> DataFrame:
    """id, label by synchronous label propagation, for graphs of any size; it need not settle on trees and bipartite graphs."""
    from loomspan.plans.lineage import fresh

    label = nodes.select("id", F.col("id").alias("label"))
    for _ in range(rounds):
        votes = links.join(label.withColumnRenamed("id", "b"), "b").groupBy("a", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("a").agg(F.max_by("label", F.struct("w", "label")).alias("next"))
        moved = fresh(label.join(best.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("next", "label").alias("next"), "label"))
        label = moved.select("id", F.col("next").alias("label"))
        if moved.where("next <> label").isEmpty():
            break
    return label


def _labels(own: DataFrame, links: DataFrame, method: str, resolution: float, max_nodes: int, max_edges: int) -> DataFrame:
    """id, label: one task a component within the bounds, distributed rounds for those beyond."""
    from loomspan.plans.lineage import fresh

    ends = links.join(own.select(F.col("id").alias("a"), "component"), "a")
    load = own.groupBy("component").agg(F.count("*").alias("n")).join(ends.groupBy("component").agg(F.count("*").alias("e")), "component", "left")
    far = fresh(load.where((F.col("n") > max_nodes) | (F.coalesce("e", F.lit(0)) > 2 * max_edges)).select("component"))
    near = _per_component(own.join(far, "component", "left_anti"), ends.join(far, "component", "left_anti").select("a", "b", "w"), method, resolution).select("id", "label")
    if far.isEmpty():
        return near
    moved = moved_labels(fresh(own.join(far, "component", "left_semi")), fresh(ends.join(far, "component", "left_semi").select("a", "b", "w")), method, resolution, max_nodes=max_nodes, max_edges=max_edges)
    return near.unionByName(moved)


def communities(nodes: DataFrame, edges: DataFrame, method: str = "greedy", resolution: float = 1.0, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> DataFrame:
    """id, community (dense, larger first), parent: communities within connected components, oversized ones split once.

    Components of fewer than WHOLE nodes stay whole. The others are clustered by
    the method: up to max_nodes nodes and max_edges edges in one task each, node
    by node in order; beyond that by ``moved_labels``, distributed rounds of the
    same moves. A community of more than max(10, a quarter of all nodes) is
    clustered again on its inner edges, in the same two ways, and the split
    stays if there is one; ``parent`` names the community before that. No nodes
    give no rows.
    """
    from loomspan.plans.lineage import fresh

    ids = nodes.select("id").distinct()
    links = fresh(damped(ids, edges.where("source <> target")).groupBy("a", "b").agg(F.sum("w").alias("w")))
    own = fresh(ids.join(components(links, "a", "b").withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")))
    small = own.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") < WHOLE).select("component")
    large = fresh(own.join(small, "component", "left_anti"))
    found = _labels(large, links.join(large.select(F.col("id").alias("a")), "a", "left_semi"), method, resolution, max_nodes, max_edges)
    label = fresh(found.unionByName(own.join(small, "component", "left_semi").select("id", F.col("component").alias("label"))))
    wide = label.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > max(10, ids.count() // 4)).select("label")
    over = fresh(label.join(wide, "label", "left_semi"))
    inner = fresh(links.join(over.withColumnsRenamed({"id": "a", "label": "la"}), "a").join(over.withColumnsRenamed({"id": "b", "label": "lb"}), "b").where("la = lb").select("a", "b", "w"))
    apart = over.select("id").join(components(inner).withColumnsRenamed({"node": "id"}), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    again = _labels(fresh(apart), inner, method, resolution, max_nodes, max_edges).withColumnRenamed("label", "fine")
    both = fresh(label.join(again, "id", "left").select("id", F.col("label").alias("parent"), F.coalesce("fine", "label").alias("label")))
    size = both.groupBy("label").agg(F.count("*").alias("n"))
    dense = numbered(size, [F.desc("n"), F.asc("label")], "community").select("label", "community")
    return ids.join(both.join(dense, "label").select("id", "community", "parent"), "id", "left")
