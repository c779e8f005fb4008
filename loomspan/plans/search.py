"""End-to-end plans: hybrid search, context building, session processing."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators import claims, events, graph, ranking, retrieval
from loomspan.plans.lineage import cut
from loomspan.schemas import lookup

DEFAULTS = {
    "importance": "double", "confidence": "double", "authority": "string", "verification": "string", "governance": "string", "conflicts": "long",
    "superseded_at": "timestamp", "superseded_by": "string", "session_ids": "array<string>", "branch": "string", "graph_proximity": "double",
    "community_score": "double", "summary": "string", "content": "string",
}


def with_defaults(memories: DataFrame) -> DataFrame:
    return memories.withColumns({k: F.lit(None).cast(t) for k, t in DEFAULTS.items() if k not in memories.columns})


def hybrid_search(memories: DataFrame, request: ranking.Request, k: int = 10, query_vector: list[float] | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """The k best memories for a request.

    Full-text hits and the 3k nearest vectors are merged by id and fused with
    all signals, families are diversified, and a type filter is hard only if a
    hit of an asked type is left.
    """
    docs = with_defaults(memories)
    # The texts alone go through the matcher; the other columns are read for the hits.
    lexical = retrieval.match(docs.select("id", *retrieval.FIELD_WEIGHTS), request.query).select("id", F.col("rank").alias("score"))
    if vectors is not None and query_vector is not None:
        near = retrieval.nearest(vectors, query_vector, 3 * k).select("id", "distance")
    else:
        near = docs.limit(0).select("id", F.lit(0.0).alias("distance"))
    return ranked_hits(docs, lexical, near, request, k)


def ranked_hits(docs: DataFrame, lexical: DataFrame, near: DataFrame, request: ranking.Request, k: int) -> DataFrame:
    """The k best of merged lexical (id, score) and vector (id, distance) hits, see ``hybrid_search``."""
    merged = ranking.merge_hybrid(lexical, near)
    asked = replace(request, continuation=request.continuation or retrieval.is_continuation(request.query))
    ranked = ranking.diversify(ranking.fuse(merged.join(docs, "id"), asked))
    if request.types:
        typed = ranked.where(F.col("source_class").isin(*request.types))
        ranked = typed.unionByName(ranked.where(~typed.exists()))
    return ranking.disclose(ranked, k)


# Points of a hit for a context, apart from its score.
HIT_VERIFICATION = {"verified": 40, "user_confirmed": 34, "inferred": 10, "unverified": -6, "contradicted": -20}
HIT_AUTHORITY = {"repository": 30, "test_verified": 28, "tool_verified": 24, "user_confirmed": 18, "session_derived": 5, "model_derived": -12}
HIT_TYPE = {"constraint": 24, "decision": 22, "fix": 20, "fact": 20, "task": 18, "open_question": 18, "bug": 16, "summary": -18, "risk": -18, "change_log": -18}
ATOMIC = ("decision", "task", "constraint", "bug", "fix", "fact", "open_question")
DETAIL_CUES = ("implementation", "how", "code change", "patch", "trace", "step by step")
# Types that every context asks for, two hits each, and those that words of the objective ask for, four each.
BASE_SCOPES = (("decision",), ("task",), ("fact",), ("constraint",), ("bug", "fix"), ("open_question",))
CUED_SCOPES = (
    (("decision",), ("decision", "decide", "policy", "latest", "recent")), (("constraint",), ("constraint", "rule", "must", "guardrail")),
    (("open_question",), ("open question", "unknown", "unresolved", "question")), (("bug", "fix"), ("bug", "issue", "failure", "drift", "broken")),
    (("task",), ("task", "todo", "next step", "continue", "unfinished", "follow up")), (("fact", "fix"), ("verified", "fact", "truth", "result", "evidence")),
)
CONTINUATION_SCOPES = ((("task",), 4), (("decision",), 4), (("open_question",), 3), (("constraint",), 3), (("fix",), 3))
HINTS = {
    ("decision",): "latest verified decision policy", ("constraint",): "latest verified constraint rule guardrail", ("open_question",): "open question unresolved unknown",
    ("bug", "fix"): "verified fix bug state failure correction", ("task",): "active task unfinished follow up", ("fact", "fix"): "verified fact evidence result", ("fact",): "verified project fact",
}


def type_scopes(objective: str) -> list[tuple[tuple[str, ...], int]]:
    """Types that a context's searches ask for besides the objective's own, with the hits of each."""
    low = objective.lower()
    out = [(types, 2) for types in BASE_SCOPES] + [(types, 4) for types, cues in CUED_SCOPES if any(c in low for c in cues)]
    return out + list(CONTINUATION_SCOPES if retrieval.is_continuation(low) else ())


def scoped_query(objective: str, types: tuple[str, ...]) -> str:
    return f"{HINTS.get(types, 'verified memory')} {objective}"


def wants_detail(objective: str) -> bool:
    return any(c in objective.lower() for c in DETAIL_CUES)


def hit_priority(objective: str) -> Column:
    """Points of verification, authority and type, and the score in hundredths."""
    kinds = HIT_TYPE | {"implementation_detail": 12 if wants_detail(objective) else -4}
    points = lookup(F.col("verification"), HIT_VERIFICATION, 0) + lookup(F.col("authority"), HIT_AUTHORITY, 0) + lookup(F.col("memory_type"), kinds, 0)
    return points + F.round(F.col("final_score") * 100).cast("int")


def best_hits(hits: DataFrame, objective: str, n: int = 12) -> DataFrame:
    """The n hits of the highest priority, one an id; where atomic claims are found, summaries go, and details that the objective does not ask for."""
    scored = hits.withColumn("priority", hit_priority(objective))
    one = scored.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("priority"), F.desc("final_score")))).where("_n = 1").drop("_n")
    drop = F.col("memory_type").isin("summary", *(() if wants_detail(objective) else ("implementation_detail",)))
    kept = one.where(~drop).unionByName(one.where(drop).where(~one.where(F.col("memory_type").isin(*ATOMIC)).exists()))
    return kept.orderBy(F.desc("priority"), F.desc("final_score"), "id").limit(n)


def context_hits(memories: DataFrame, request: ranking.Request, queries: tuple[str, ...] = (), n: int = 12, scopes: bool = True) -> DataFrame:
    """Hits of the objective, of further queries and of the types that a context asks for, merged by id.

    The texts are matched against all queries in one pass; what matched any of
    them is kept, and the searches go on from there.
    """
    asked = [(request.query, request.types, n), *[(q, request.types, n) for q in queries]]
    asked += [(scoped_query(request.query, types), types, most) for types, most in type_scopes(request.query)] if scopes else []
    docs = with_defaults(memories)
    distinct = list(dict.fromkeys(q for q, _, _ in asked))
    ranks = cut(retrieval.match_all(docs.select("id", *retrieval.FIELD_WEIGHTS), distinct))
    near = cut(docs.join(ranks, "id"))
    found = None
    for q, types, most in asked:
        lexical = ranks.select("id", F.get("ranks", F.lit(distinct.index(q))).alias("score")).where("score is not null")
        hits = ranked_hits(near.drop("ranks"), lexical, near.limit(0).select("id", F.lit(0.0).alias("distance")), replace(request, query=q, types=types), most).drop("rank", "level")
        found = hits if found is None else found.unionByName(hits)
    return best_hits(found, request.query, n)


def session_pipeline(stream_of_events: DataFrame, summaries: DataFrame | None = None) -> dict[str, DataFrame]:
    """Episodes, memories and graph of sessions' events."""
    segmented = events.episodes_of(stream_of_events)
    episodes = events.materialise_episodes(segmented)
    memories = claims.session_memories(segmented, episodes, summaries)
    nodes, edges = graph.structural_graph(stream_of_events)
    more_nodes, more_edges = graph.episode_graph(episodes)
    return {"episodes": episodes, "memories": memories, "nodes": nodes.unionByName(more_nodes), "edges": edges.unionByName(more_edges)}
