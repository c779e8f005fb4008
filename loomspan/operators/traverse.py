"""Graph queries: neighbourhoods, shortest paths, goal-directed search, node search, community relevance."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import GOAL_STOPWORDS
from loomspan.operators.graph import both_ways, hubs, is_noisy_path
from loomspan.plans.lineage import cut

PRUNE, PATHS = 0.15, 5


def neighbours(edges: DataFrame, starts: DataFrame, hops: int = 1) -> DataFrame:
    """id and hop of the nodes within ``hops`` (1 to 5) of the starts (column id), edges taken both ways.

    Each hop joins the frontier alone with the edges; what was reached before
    is anti-joined away, so a node is expanded once.
    """
    hops = min(5, max(1, hops))
    links = both_ways(edges).select("a", "b").distinct()
    reached = starts.select("id").distinct().withColumn("hop", F.lit(0))
    frontier = reached
    for k in range(1, hops + 1):
        step = frontier.select(F.col("id").alias("a")).join(links, "a").select(F.col("b").alias("id")).distinct()
        frontier = cut(step.join(reached, "id", "left_anti").withColumn("hop", F.lit(k)))
        reached = reached.unionByName(frontier)
    return reached


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among the ids."""
    i = ids.select("id").distinct()
    return edges.join(i.withColumnRenamed("id", "source"), "source", "left_semi").join(i.withColumnRenamed("id", "target"), "target", "left_semi")


def shortest_path(edges: DataFrame, start: str, goal: str, most: int = 50) -> DataFrame:
    """A shortest path as pos and id: of several, the one of the smallest predecessors. No rows without a path.

    Breadth first over distributed frontiers, one predecessor kept a node; the
    path is read backwards by point lookups, one a hop.
    """
    spark = edges.sparkSession
    if start == goal:
        return spark.createDataFrame([(0, start)], "pos int, id string")
    links = both_ways(edges).select("a", "b").distinct()
    seen = spark.createDataFrame([(start, None, 0)], "id string, prior string, hop int")
    frontier = seen
    for k in range(1, most + 1):
        step = frontier.select(F.col("id").alias("a")).join(links, "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("prior"))
        frontier = cut(step.join(seen, "id", "left_anti").withColumn("hop", F.lit(k)))
        if frontier.isEmpty():
            return spark.createDataFrame([], "pos int, id string")
        seen = cut(seen.unionByName(frontier))
        if not frontier.where(F.col("id") == goal).isEmpty():
            break
    else:
        return spark.createDataFrame([], "pos int, id string")
    path = [goal]
    while path[-1] != start:
        path.append(seen.where(F.col("id") == path[-1]).first()["prior"])
    return spark.createDataFrame(list(enumerate(reversed(path))), "pos int, id string")


def path_edges(edges: DataFrame, path: DataFrame) -> DataFrame:
    """One edge for each hop of a path, the smallest relation."""
    pairs = path.select(F.col("pos"), F.col("id").alias("a")).join(path.select((F.col("pos") - 1).alias("pos"), F.col("id").alias("b")), "pos")
    e = edges.select("*", F.least("source", "target").alias("_l"), F.greatest("source", "target").alias("_h"))
    near = pairs.select("pos", F.least("a", "b").alias("_l"), F.greatest("a", "b").alias("_h")).join(e, ["_l", "_h"])
    return near.withColumn("_n", F.row_number().over(Window.partitionBy("pos").orderBy("relation", "source"))).where("_n = 1").drop("_n", "_l", "_h")


def parse_goals(text: str) -> list[str]:
    """Distinct tokens of three characters or more that are no stop words, in order."""
    found = [t for t in re.findall(r"[a-z0-9_./:+-]+", text.lower()) if len(t) >= 3 and t not in GOAL_STOPWORDS]
    return list(dict.fromkeys(found))


def coverage(haystack: Column, goals: list[str]) -> Column:
    """The numbers of the goals that the text holds, in order; there may be any number of goals."""
    listed = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(g).alias("g")) for k, g in enumerate(goals)])
    return F.transform(F.filter(listed, lambda x: F.contains(haystack, x["g"])), lambda x: x["k"])


def _metadata(df: DataFrame) -> Column:
    """A node's metadata as JSON with sorted keys."""
    if "metadata" not in df.columns:
        return F.lit("{}")
    return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("metadata")))), F.lit("{}"))


def goal_search(nodes: DataFrame, edges: DataFrame, text: str, start: str | None = None, hops: int = 3) -> DataFrame:
    """Up to five paths from a start that cover the goals of a text: covered, uncovered, length, path, complete.

    Frontier rows are (node, covered goals, path, edges taken); an edge whose text
    holds less than 15 % of the open goals is pruned, no path takes an edge
    twice, and each (node, covered goals) is visited once, by its first path in
    order of node ids. Without a start, the node that covers most goals is one.
    Complete paths come first, by length; if there are none, those with the
    fewest goals open; if there are none either, the bare start. A start that is
    not there gives no rows.
    """
    goals = parse_goals(text)
    spark = nodes.sparkSession
    schema = "path array<string>, length int, covered int, uncovered int, complete boolean"
    if not goals:
        return spark.createDataFrame([], schema)
    own = F.lower(F.concat_ws(" ", "id", "label", _metadata(nodes)))
    known = cut(nodes.select("id", F.lower("label").alias("label"), coverage(own, goals).alias("own")))
    best = known.where(F.col("id") == start) if start else known.orderBy(F.desc(F.size("own")), "id").limit(1)
    none = F.array().cast("array<bigint>")
    frontier = best.select(F.col("id").alias("node"), F.col("label").alias("from_label"), F.col("own").alias("got"), F.array("id").alias("path"), none.alias("taken"))
    numbered = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "relation").withColumn("edge", F.xxhash64("a", "b", "relation"))
    links = numbered.unionByName(numbered.select(F.col("b").alias("a"), F.col("a").alias("b"), "relation", "edge")).distinct()
    full = len(goals)
    seen = frontier.select("node", "got")
    done, partial = frontier.where(F.size("got") == full), frontier.where("false")
    frontier = frontier.where(F.size("got") < full)
    for _ in range(max(1, hops)):
        near = frontier.join(links, frontier.node == links.a).join(known.select(F.col("id").alias("b"), F.col("label").alias("to_label"), "own"), "b")
        edge_text = F.lower(F.concat_ws(" ", "from_label", "node", "relation", "to_label", "b"))
        gain = F.size(F.array_except(coverage(edge_text, goals), F.col("got"))) / (F.lit(full) - F.size("got"))
        step = near.where(~F.array_contains("taken", F.col("edge"))).where(gain >= PRUNE).select(
            F.col("b").alias("node"), F.col("to_label").alias("from_label"), F.array_sort(F.array_union("got", "own")).alias("got"),
            F.array_append("path", F.col("b")).alias("path"), F.array_append("taken", F.col("edge")).alias("taken"),
        )
        one = Window.partitionBy("node", "got").orderBy(F.array_join("path", "\x01"), F.array_join(F.transform("taken", lambda x: x.cast("string")), " "))
        step = step.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
        step = cut(step.join(seen, ["node", "got"], "left_anti"))
        if step.isEmpty():
            break
        seen = seen.unionByName(step.select("node", "got"))
        done, partial = done.unionByName(step.where(F.size("got") == full)), partial.unionByName(step.where(F.size("got") < full))
        frontier = step.where(F.size("got") < full)
    scored = done.withColumn("complete", F.lit(True)).unionByName(partial.withColumn("complete", F.lit(False)))
    out = scored.select("path", (F.size("path") - 1).alias("length"), F.size("got").alias("covered"), (F.lit(full) - F.size("got")).alias("uncovered"), "complete")
    bare = best.select(F.array("id").alias("path"), F.lit(0).alias("length"), F.size("own").alias("covered"), (F.lit(full) - F.size("own")).alias("uncovered"), (F.size("own") == full).alias("complete"))
    best_kind = out.where("complete").unionByName(out.where("not complete").where(~out.where("complete").exists())).unionByName(bare.where(~out.exists()))
    return best_kind.orderBy("uncovered", "length", F.array_join("path", "\x01")).limit(PATHS)


def looks_like_path(query: str) -> bool:
    return any(c in query for c in "/\\.")


def looks_like_identifier(query: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z0-9_:.-]*", query))


# Points of a node for a query, by what it matches.
FILE_POINTS = {"exact": 260.0, "name": 220.0, "path_end": 170.0, "name_start": 140.0, "path_part": 110.0, "extension": 40.0, "not_a_file": -48.0}
SYMBOL_POINTS, SYMBOL_KIND, SYMBOL_IDENTIFIER = (240.0, 180.0, 110.0), 36.0, 18.0
MODULE_POINTS, HEADING_POINTS = (210.0, 145.0, 90.0), (190.0, 135.0, 92.0)
TAG_POINTS, BODY_POINTS = 170.0, 80.0
TOKEN_POINTS = {"name": 18.0, "path": 11.0, "heading": 9.0, "long": 2.0, "short": 1.0}
WHOLE_POINTS, PART_POINTS, PATH_QUERY, NOISE, SEED = 12.0, 4.0, 24.0, -24.0, 1000.0
TITLED = ("section", "decision", "task", "rationale")


def _points(condition: Column, n: float) -> Column:
    return F.when(condition, n).otherwise(0.0)


def _tiers(points: tuple[float, float, float], q: str, *values: Column) -> Column:
    """Points where one of the values is the query, else begins with it, else holds it."""
    some = lambda test: functools.reduce(lambda x, y: x | y, [F.coalesce(test(v), F.lit(False)) for v in values])
    return F.when(some(lambda v: v == q), points[0]).when(some(lambda v: v.startswith(q)), points[1]).when(some(lambda v: F.contains(v, F.lit(q))), points[2]).otherwise(0.0)


def node_score(nodes: DataFrame, query: str) -> Column:
    """How well a node answers a query: rules for files, symbols, modules, headings, rationales and tokens, less noise.

    nodes: id, label, node_type, and where there are, source_id, source_file and
    ``metadata`` (map of strings: fullPath, basename, extension, symbolKind,
    importSource, heading, tag, body, sourceFile). A query without tokens scores nothing.
    """
    q = query.lower()
    tokens = re.findall(r"[a-z0-9_./:+-]+", q)
    if not tokens:
        return F.lit(0.0)
    has = lambda name: name in nodes.columns
    none = F.lit(None).cast("string")
    meta = lambda key: F.lower(F.col("metadata")[key]) if has("metadata") else none
    kind, label, id_ = F.col("node_type"), F.lower("label"), F.lower("id")
    source_id = F.lower(F.coalesce("source_id", F.lit(""))) if has("source_id") else F.lit("")
    file = kind.isin("file", "document")
    path = F.coalesce(meta("fullPath"), F.when(file, source_id))
    source_file = F.coalesce(meta("sourceFile"), F.lower("source_file") if has("source_file") else none)
    name = F.coalesce(meta("basename"), F.nullif(F.regexp_extract(path, "([^/]*)/*$", 1), F.lit("")))
    ending = F.coalesce(meta("extension"), F.nullif(F.regexp_extract(name, r"^.+\.([^.]*)$", 1), F.lit("")))
    heading = F.coalesce(meta("heading"), F.when(kind.isin(*TITLED), label))
    tag, body, imported = meta("tag"), meta("body"), meta("importSource")
    hay = F.lower(F.concat_ws(" ", F.col("id"), F.col("label"), _metadata(nodes)))
    holds = lambda x, part: F.contains(x, F.lit(part))
    asks_path, asks_name = looks_like_path(q), looks_like_identifier(q)

    p = FILE_POINTS
    of_file = (
        _points((id_ == "file:" + q) | (source_id == q) | F.coalesce(path == q, F.lit(False)) | F.coalesce(source_file == q, F.lit(False)), p["exact"])
        + _points(name == q, p["name"]) + _points(path.endswith(q), p["path_end"]) + _points(name.startswith(q), p["name_start"])
        + _points(holds(path, q), p["path_part"]) + _points(ending == q.lstrip("."), p["extension"]) + (PATH_QUERY if asks_path else 0.0)
    )
    score = F.when(file, of_file).otherwise(p["not_a_file"] if asks_path else 0.0)
    symbol = _tiers(SYMBOL_POINTS, q, label) + _points(meta("symbolKind") == q, SYMBOL_KIND) + (SYMBOL_IDENTIFIER if asks_name else 0.0)
    score += F.when(kind == "symbol", symbol).otherwise(0.0)
    score += F.when(kind == "module", _tiers(MODULE_POINTS, q, label, imported)).otherwise(0.0)
    score += F.when(kind.isin(*TITLED, "document"), _tiers(HEADING_POINTS, q, heading, label)).otherwise(0.0)
    score += _points(tag == q, TAG_POINTS) + _points(holds(body, q), BODY_POINTS)
    t = TOKEN_POINTS
    for x in tokens:
        score += _points((F.coalesce(name == x, F.lit(False))) | (label == x), t["name"]) + _points(holds(path, x), t["path"])
        score += _points(F.coalesce(holds(heading, x), F.lit(False)) | F.coalesce(holds(body, x), F.lit(False)), t["heading"])
        score += _points(holds(hay, x), t["long"] if len(x.encode()) > 3 else t["short"])
    score += F.when(hay == q, WHOLE_POINTS).when(holds(hay, q), PART_POINTS).otherwise(0.0)
    return score + _points(is_noisy_path(F.coalesce(path, source_file, F.lit(""))), NOISE)


def search_nodes(nodes: DataFrame, query: str, n: int = 10, per_source: int = 2, seed: str | None = None) -> DataFrame:
    """The n best nodes with a score above 0, by score, label and id; of one source two at most.

    Files, documents and nodes without a source are exempt from that. A seed
    node comes first.
    """
    score = node_score(nodes, query)
    scored = nodes.withColumn("score", F.when(F.col("id") == seed, SEED).otherwise(score) if seed else score).where("score > 0")
    own = F.concat(F.lit("\x01"), "id")
    known = [F.col("metadata")["sourceFile"]] if "metadata" in nodes.columns else []
    known += [F.col("source_file")] if "source_file" in nodes.columns else []
    known += [F.nullif("source_id", F.lit(""))] if "source_id" in nodes.columns else []
    source = F.when(F.col("node_type").isin("file", "document"), own).otherwise(F.coalesce(*known, own))
    w = Window.partitionBy(source).orderBy(F.desc("score"), "label", "id")
    return scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_source).drop("_n").orderBy(F.desc("score"), "label", "id").limit(n)


def incident(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among the ids."""
    i = ids.select("id").distinct().withColumn("_in", F.lit(True))
    out = edges.join(i.withColumnsRenamed({"id": "source", "_in": "_s"}), "source", "left").join(i.withColumnsRenamed({"id": "target", "_in": "_t"}), "target", "left")
    return out.where("_s or _t").select(*edges.columns)


def community_nodes(members: DataFrame, nodes: DataFrame, edges: DataFrame, community: int | None = None) -> tuple[DataFrame, DataFrame]:
    own = members if community is None else members.where(F.col("community") == community)
    found = nodes.join(own, "id")
    return found, incident(edges, found)


def community_relevance(communities: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """community, relevance: the share of a text's goals in its label and its representatives' labels and ids."""
    goals = parse_goals(text)
    named = communities.select("community", "label", F.explode_outer("representative_nodes").alias("id")).join(nodes.select("id", F.col("label").alias("node_label")), "id", "left")
    hay = named.groupBy("community", "label").agg(F.lower(F.concat_ws(" ", F.col("label"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "id", "node_label"))), " "))).alias("hay"))
    share = F.size(coverage(F.col("hay"), goals)) / len(goals) if goals else F.lit(0.0)
    return hay.select("community", share.cast("double").alias("relevance"))


def query(kind: str, nodes: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """The façade of graph queries: hub_nodes, neighbors, shortest_path, communities, search, goal_directed."""
    if kind == "hub_nodes":
        return hubs(nodes, edges, options.get("limit", 10))
    if kind == "neighbors":
        start = nodes.where(F.col("id") == options["node"]).select("id")
        return nodes.join(neighbours(edges, start, options.get("depth", 1)), "id")
    if kind == "shortest_path":
        return shortest_path(edges, options["source"], options["target"])
    if kind == "communities":
        return community_nodes(options["members"], nodes, edges, options.get("community"))[0]
    if kind == "search":
        return search_nodes(nodes, options["text"], options.get("limit", 10))
    if kind == "goal_directed":
        return goal_search(nodes, edges, options["text"], options.get("node"), options.get("hops", 3))
    raise ValueError(f"unknown graph query {kind}")
