"""Score fusion, priors, boosts and penalties of retrieved memories, and diversification of the ranked list."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import age_days, canonical, clamp01
from loomspan.schemas import lookup

# Fixed values.
AUTHORITY_BOOST = {"repository": 0.18, "test_verified": 0.15, "tool_verified": 0.12, "user_confirmed": 0.10, "session_derived": 0.04, "model_derived": 0.0}
VERIFICATION_BOOST = {"verified": 0.10, "user_confirmed": 0.08, "inferred": 0.02, "contradicted": -0.20, "unverified": 0.0}
GOVERNANCE_BOOST = {"pinned": 0.20, "archived": -0.50, "rejected": -0.80}
REPOSITORY_PRIOR = {
    "decision": 0.16, "fact": 0.16, "implementation_detail": 0.16, "constraint": 0.16, "fix": 0.16, "task": 0.08,
    "open_question": -0.04, "session_summary": -0.28, "reflection": -0.28, "summary": -0.14,
}
MEMORY_PRIOR = {
    "decision": 0.22, "fact": 0.22, "task": 0.18, "constraint": 0.2, "implementation_detail": 0.14, "bug": 0.12, "fix": 0.18,
    "open_question": 0.1, "risk": 0.08, "summary": -0.08,
}
ROLES = {
    "decision": "durable_decision", "task": "active_task", "constraint": "constraint_guardrail", "fact": "project_fact",
    "implementation_detail": "implementation_note", "bug": "known_bug", "fix": "verified_fix", "open_question": "open_question",
    "reflection": "reflection_fallback", "session_summary": "continuity_fallback",
}
SIGNAL_WEIGHTS = {"lexical": 0.32, "semantic": 0.30, "session": 0.12, "graph": 0.10, "recency": 0.08, "importance": 0.08, "confidence": 0.06}
RECENCY = ((1, 1.0), (7, 0.85), (30, 0.65), (90, 0.4))
STALE = (
    (("task", "implementation_detail", "open_question"), 14, 0.5), (("bug", "fix"), 30, 0.3), (("decision", "fact", "constraint"), 180, 0.1),
)
ACTIONABLE = ("task", "decision", "constraint", "open_question", "fix")
GENERIC = ("session_summary", "reflection", "summary")


@dataclass(frozen=True)
class Request:
    """What a search is ranked for."""

    query: str = ""
    now: datetime = datetime(2026, 1, 1)
    intent: str = "hybrid"
    session_id: str | None = None
    branch: str | None = None
    types: tuple[str, ...] = ()
    continuation: bool = False


def recency(at: Column, now: Column) -> Column:
    days = age_days(at, now)
    out = F.when(F.lit(False), 0.0)
    for most, score in RECENCY:
        out = out.when(days <= most, score)
    return out.otherwise(0.2)


def staleness(kind: Column, at: Column, now: Column, superseded_at: Column) -> Column:
    days = age_days(at, now)
    out = F.when(superseded_at.isNotNull(), 1.0)
    for kinds, limit, penalty in STALE:
        out = out.when(kind.isin(*kinds), F.when(days > limit, penalty).otherwise(0.0))
    return out.otherwise(F.when(days > 90, 0.2).otherwise(0.0))


def source_class(kind: Column, title: Column) -> Column:
    low = F.lower(title)
    summed = low.startswith("session summary") | low.startswith("episode ") | low.rlike(": (debugging|conversation|implementation) -")
    return F.when(low.contains("session reflection"), "reflection").when((kind == "summary") & summed, "session_summary").otherwise(kind)


def ranking_role(source: Column, kind: Column) -> Column:
    return F.coalesce(lookup(source, ROLES, None), F.when(kind == "summary", "summary_fallback").otherwise("general_memory"))


def source_prior(source: Column, kind: Column, request: Request) -> Column:
    if request.intent == "none":
        return F.lit(-0.30)
    if request.intent == "repository_only":
        return lookup(source, REPOSITORY_PRIOR, 0.0)
    query = request.query.lower()
    session = "session" in query or "history" in query
    reflecting = session or "reflection" in query or "risk" in query
    table = MEMORY_PRIOR | {"reflection": 0.04 if reflecting else -0.24, "session_summary": -0.04 if session else -0.18}
    return F.coalesce(lookup(source, table, None), F.when(kind == "summary", -0.06).otherwise(0.0))


def continuation_boost(superseded: Column, kind: Column, recency_: Column) -> Column:
    recent, act = recency_ >= 0.65, kind.isin(*ACTIONABLE)
    return F.when(superseded, -0.20).when(act & recent, 0.30).when(act, 0.15).when(recent, 0.05).otherwise(0.0)


def merge_hybrid(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Outer merge by id. lexical: id, score, ...; semantic: id, distance, and may have session_ids. Adds lexical_score, semantic_score, score.

    Of several distances the least counts. Session ids of both sides are united,
    those of the lexical side first.
    """
    united = "session_ids" in semantic.columns
    sums = [(1.0 / (1.0 + F.min("distance"))).alias("semantic_score")]
    sums += [F.array_sort(F.array_distinct(F.flatten(F.collect_list("session_ids")))).alias("_near_sessions")] if united else []
    out = lexical.withColumnRenamed("score", "lexical_score").join(semantic.groupBy("id").agg(*sums), "id", "full")
    if united:
        none = F.array().cast("array<string>")
        own = F.coalesce("session_ids", none) if "session_ids" in lexical.columns else none
        out = out.withColumn("session_ids", F.array_union(own, F.coalesce("_near_sessions", none))).drop("_near_sessions")
    return out.withColumn("score", F.greatest(F.coalesce("lexical_score", F.lit(0.0)), F.coalesce("semantic_score", F.lit(0.0))))


def fuse(hits: DataFrame, request: Request) -> DataFrame:
    """Hits with ``final_score`` and its signals.

    hits: id, memory_type, title, created_at, lexical_score, semantic_score,
    importance, confidence, authority, verification, governance, conflicts,
    superseded_at, superseded_by, session_ids, branch, graph_proximity,
    community_score. One projection: no join, no shuffle.
    """
    now = F.lit(request.now)
    kind = F.col("memory_type")
    source = source_class(kind, F.col("title"))
    exact = F.array_contains("session_ids", request.session_id) if request.session_id else F.lit(False)
    exact = F.coalesce(exact, F.lit(False))
    branch = F.coalesce(F.col("branch") == request.branch, F.lit(False)) if request.branch else F.lit(False)
    superseded = F.col("superseded_at").isNotNull() | F.col("superseded_by").isNotNull()
    signals = {
        "source_class": source,
        "ranking_role": ranking_role(source, kind),
        "exact_session": exact,
        "session_relevance": F.when(exact, 1.0).when(branch, 0.45).otherwise(0.0),
        "recency": recency(F.col("created_at"), now),
        "staleness": staleness(kind, F.col("created_at"), now, F.col("superseded_at")),
    }
    parts = {
        "lexical": F.col("lexical_score"), "semantic": F.col("semantic_score"), "session": F.col("session_relevance"), "graph": F.col("graph_proximity"),
        "recency": F.col("recency"), "importance": F.col("importance"), "confidence": F.col("confidence"),
    }
    score = sum((clamp01(parts[k]) * w for k, w in SIGNAL_WEIGHTS.items()), F.lit(0.0))
    score += source_prior(F.col("source_class"), kind, request) + lookup(F.col("authority"), AUTHORITY_BOOST, 0.0) + lookup(F.col("verification"), VERIFICATION_BOOST, 0.0)
    if request.types:
        score += F.when(F.col("source_class").isin(*request.types), 0.25).otherwise(-0.15)
    score += clamp01(F.col("community_score")) * 0.15 + lookup(F.col("governance"), GOVERNANCE_BOOST, 0.0)
    if request.continuation:
        score += continuation_boost(superseded, kind, F.col("recency"))
    score -= clamp01(F.col("staleness")) * 0.10 + F.when(superseded, 0.10).otherwise(0.0) + F.least(F.lit(0.24), F.coalesce("conflicts", F.lit(0)) * 0.08)
    return hits.withColumns(signals).withColumn("final_score", score + F.when(F.col("exact_session"), 0.5).otherwise(0.0))


def family_key(title: Column, summary: Column) -> Column:
    return F.coalesce(F.nullif(canonical(title), F.lit("")), canonical(summary))


def diversify(ranked: DataFrame, order: tuple = (), group: tuple[str, ...] = ()) -> DataFrame:
    """The best hit of each family of class and title, then the best generic hit of each first session."""
    best = [*order] or [F.desc("final_score"), F.desc("created_at"), F.asc("id")]
    family = Window.partitionBy(*group, "source_class", family_key(F.col("title"), F.col("summary"))).orderBy(*best)
    first = ranked.withColumn("_family", F.row_number().over(family)).where("_family = 1").drop("_family")
    session = F.get("session_ids", F.lit(0))
    generic = F.col("source_class").isin(*GENERIC) & session.isNotNull()
    # Other hits are a partition each, so that the window is not one large group of nulls.
    per = Window.partitionBy(*group, F.when(generic, session).otherwise(F.concat(F.lit("\x01"), F.col("id").cast("string")))).orderBy(*best)
    return first.withColumn("_nth", F.row_number().over(per)).where("_nth = 1").drop("_nth")


def dedupe_by_provenance(hits: DataFrame, order: tuple = ()) -> DataFrame:
    """The best hit of each set of sources (array of session:event in ``provenance``)."""
    best = [*order] or [F.desc("final_score"), F.asc("id")]
    key = F.array_join(F.array_sort("provenance"), "|")
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*best))).where("_n = 1").drop("_n")


def disclose(ranked: DataFrame, n: int = 50) -> DataFrame:
    """The top n with their rank and level: overview (5), related (12), full."""
    top = ranked.orderBy(F.desc("final_score"), F.desc("created_at"), F.asc("id")).limit(n)
    place = F.row_number().over(Window.orderBy(F.desc("final_score"), F.desc("created_at"), F.asc("id")))
    out = top.withColumn("rank", place)
    return out.withColumn("level", F.when(F.col("rank") <= 5, "overview").when(F.col("rank") <= 12, "related").otherwise("full"))
