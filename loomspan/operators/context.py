"""Context packing: priorities, quotas, budgets with skips, weighted set cover, gaps and advice."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import contains_any
from loomspan.operators.claims import is_truth
from loomspan.plans.lineage import cut
from loomspan.schemas import lookup

# Fixed values.
SOURCE_PRIORITY = {
    "repository": {"repository_only": 70, "hybrid": 60, "*": 30}, "memory": {"memory_only": 60, "hybrid": 50, "*": 25},
    "session_graph": {"session_graph_only": 55, "hybrid": 30, "memory_only": 30, "*": 10}, "conflict": {"*": 45},
}
VERIFICATION_PRIORITY = {"verified": 25, "user_confirmed": 20, "inferred": 8, "unverified": -4, "contradicted": -15}
AUTHORITY_PRIORITY = {"repository": 20, "test_verified": 18, "tool_verified": 16, "user_confirmed": 14, "session_derived": 4, "model_derived": -10}
TYPE_PRIORITY = {
    "decision": 14, "fact": 14, "constraint": 14, "fix": 14, "task": 10, "bug": 10, "implementation_detail": 8, "open_question": 6,
    "summary": -6, "risk": -6, "change_log": -6,
}
QUOTAS = {
    "none": {"*": 0}, "repository_only": {"repository": 6, "*": 2}, "memory_only": {"session_graph": 2, "conflict": 2, "*": 3},
    "session_graph_only": {"session_graph": 6, "conflict": 2, "*": 0}, "hybrid": {"repository": 4, "*": 2},
}
GOAL_OF_TYPE = {
    "decision": "decisions", "task": "active_tasks", "fact": "facts", "bug": "bugs", "fix": "fixes", "constraint": "constraints",
    "implementation_detail": "implementation", "open_question": "open_questions",
}
GOAL_CUES = (
    (("bugs", "fixes"), ("bug", "error", "debug", "fail")), (("constraints",), ("constraint", "must ", "requirement", "invariant")),
    (("implementation",), ("implement", "refactor", "build ", "code", "module")), (("open_questions",), ("question", "unknown", "unclear", "open ")),
)
AUTHORITY_FACTOR = {"repository": 1.0, "user_confirmed": 1.0, "tool_verified": 0.95, "test_verified": 0.95, "session_derived": 0.55, "model_derived": 0.0}
FILLER = {
    "repository": {"repository_only": 0.8, "hybrid": 0.8, "*": 0.3}, "memory": {"*": 0.6},
    "session_graph": {"session_graph_only": 0.5, "hybrid": 0.5, "*": 0.2}, "conflict": {"*": 0.7},
}
PACK_SECTIONS = {
    "project_facts": "fact", "recent_decisions": "decision", "active_tasks": "task", "constraints": "constraint", "known_bugs": "bug", "verified_fixes": "fix",
    "open_questions": "open_question", "implementation_notes": "implementation_detail",
}
SECTIONS = {
    "decision": "decisions", "task": "active_tasks", "constraint": "constraints", "fact": "facts", "bug": "bugs", "fix": "fixes",
    "open_question": "open_questions", "implementation_detail": "implementation_details", "summary": "summaries", "risk": "risks", "change_log": "change_log",
}


def _of(table: dict, intent: str) -> dict:
    return {k: v.get(intent, v["*"]) for k, v in table.items()}


def priority(intent: str) -> Column:
    """Integer weight of an item: its source for the intent, verification, authority and type."""
    return (
        lookup(F.col("source_class"), _of(SOURCE_PRIORITY, intent), 0) + lookup(F.col("verification"), VERIFICATION_PRIORITY, 0)
        + lookup(F.col("authority"), AUTHORITY_PRIORITY, 0) + lookup(F.col("memory_type"), TYPE_PRIORITY, 0)
    )


def bucket() -> Column:
    return F.when(F.col("source_class") == "memory", F.concat(F.lit("memory:"), "memory_type")).otherwise(F.col("source_class"))


def quota(intent: str) -> Column:
    table = QUOTAS.get(intent, QUOTAS["hybrid"])
    return lookup(bucket(), {k: v for k, v in table.items() if k != "*"}, table["*"])


def section() -> Column:
    return F.when(F.col("source_class") == "memory", lookup(F.col("memory_type"), SECTIONS, "summaries")).otherwise(F.col("source_class"))


def dedupe_key(items: DataFrame) -> Column:
    """The claim key, else source, title and summary in lower case; where items have no titles, each is its own."""
    own = F.lit("") if "title" in items.columns else F.col("item_id").cast("string")
    parts = [F.lower(F.trim(_text(items, c))) for c in ("title", "summary")]
    return F.coalesce(F.col("claim_key").cast("string"), F.concat_ws("\x01", F.lit(""), F.col("source_class"), *parts, own))


def pack(items: DataFrame, budget: int, intent: str = "hybrid", request: str = "request_id") -> DataFrame:
    """Items of each request that fit its budget, by priority and then size, larger first: request, item_id, section, tokens, priority, used_tokens.

    items: request, item_id, source_class, memory_type, claim_key, verification,
    authority, tokens. One item a claim key, the first; then each that its
    bucket's quota and the budget still admit is taken. What does not fit takes
    nothing of its quota.

    Of items of one bucket and as many tokens the first ``quota`` are enough: once
    one does not fit, none of its size does. So a request's fold sees at most
    quota rows for each bucket and each size up to the budget, however many its candidates.
    """
    w = lambda *by: Window.partitionBy(request, *by).orderBy(F.desc("priority"), F.desc("tokens"), "item_id")
    scored = items.withColumn("tokens", F.coalesce(F.col("tokens").cast("long"), F.lit(0)))
    scored = scored.withColumns({"priority": priority(intent), "bucket": F.coalesce(bucket(), F.lit("")), "quota": F.coalesce(quota(intent), F.lit(0)), "section": section(), "_key": dedupe_key(items)})
    once = scored.withColumn("_k", F.row_number().over(w("_key"))).where("_k = 1")
    few = once.where(F.col("tokens") <= budget).withColumn("_q", F.row_number().over(w("bucket", "tokens"))).where(F.col("_q") <= F.col("quota"))
    few = few.select(request, "item_id", "section", "tokens", "priority", "bucket", "quota")
    kind = dict(items.dtypes)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["priority", "tokens", "item_id"], ascending=[False, False, True], kind="stable")
        used, counts, keep = 0, {}, []
        for tokens, of, most in zip(frame["tokens"], frame["bucket"], frame["quota"], strict=True):
            keep.append(counts.get(of, 0) < most and used + tokens <= budget)
            if keep[-1]:
                used += tokens
                counts[of] = counts.get(of, 0) + 1
        return frame.loc[keep, [request, "item_id", "section", "tokens", "priority"]].assign(used_tokens=used)

    return few.groupBy(request).applyInPandas(fold, f"{request} {kind[request]}, item_id {kind['item_id']}, section string, tokens long, priority int, used_tokens long")


def context_pack(items: DataFrame, chosen: DataFrame, truth: Column | None = None, request: str = "request_id") -> DataFrame:
    """The sections of a request's pack as arrays of item ids, its unique proofs and sources, in order.

    items may have ``proof_handles`` (array of structs source_ref, session_id,
    session_event_id, proof_type, ...) and ``sources`` (session_id,
    session_event_id, excerpt). chosen: request, item_id and, for an order of its
    own, place. ``truth`` says what of memory is current truth: by default strong
    verification or authority; ``verified_truth`` is the compiler's.
    Repository items are truth, conflicts and session items never are.
    """
    place = F.col("place") if "place" in chosen.columns else F.struct(-F.col("priority"), -F.col("tokens"))
    own = items.join(chosen.select(request, "item_id", place.alias("_place")), [request, "item_id"])
    strong = is_truth(F.col("verification"), F.col("authority")) if truth is None else truth
    memory = F.col("source_class") == "memory"
    sections = {"current_truth": (F.col("source_class") == "repository") | (memory & strong)}
    sections |= {name: memory & (F.col("memory_type") == kind) for name, kind in PACK_SECTIONS.items()}
    sections |= {"repository_knowledge": F.col("source_class") == "repository", "session_continuity": F.col("source_class") == "session_graph"}
    sections |= {"conflicts": (F.col("source_class") == "conflict") | F.coalesce(F.col("verification") == "contradicted", F.lit(False))}
    listed = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("_place", "item_id")))), lambda x: x["item_id"])
    out = own.groupBy(request).agg(*[listed(when).alias(name) for name, when in sections.items()])
    for name, keys in (("proof_handles", ("source_ref", "session_id", "session_event_id", "proof_type")), ("sources", ("session_id", "session_event_id"))):
        if name in items.columns:
            last = _last_by_key(own, request, name, keys).withColumnRenamed(request, "_request")
            none = F.array().cast(items.schema[name].dataType)
            out = out.join(last, F.col(request).eqNullSafe(F.col("_request")), "left").withColumn(name, F.coalesce(name, none)).drop("_request")
    return out


def verified_truth() -> Column:
    return F.coalesce(F.col("verification").isin("verified", "user_confirmed"), F.lit(False))


def _last_by_key(own: DataFrame, request: str, name: str, keys: tuple[str, ...]) -> DataFrame:
    """request, name: of an array column's structs, the last in item order of each key, by key. Only one a key is gathered."""
    each = own.select(request, "_place", "item_id", F.posexplode(name).alias("_i", "_x"))
    last = each.groupBy(request, *[F.col("_x")[k].alias(f"_{k}") for k in keys]).agg(F.max_by("_x", F.struct("_place", "item_id", "_i")).alias("_x"))
    listed = F.array_sort(F.collect_list(F.struct(*[f"_{k}" for k in keys], "_x")))
    return last.groupBy(request).agg(F.transform(listed, lambda x: x["_x"]).alias(name))


def goals_of(objective: Column) -> Column:
    """The core goals, and those that the objective's words ask for."""
    low = F.lower(objective)
    more = [F.when(contains_any(low, cues), F.array(*map(F.lit, goals))).otherwise(F.array().cast("array<string>")) for goals, cues in GOAL_CUES]
    return F.array_distinct(F.concat(F.array(F.lit("decisions"), F.lit("active_tasks"), F.lit("facts")), *more))


def covers() -> Column:
    return F.when(F.col("source_class") == "memory", lookup(F.col("memory_type"), GOAL_OF_TYPE, None))


def freshness() -> Column:
    return F.when(F.coalesce(F.col("valid_to").cast("string"), F.lit("")) != "", 0.35).otherwise(1.0)


def authority_factor() -> Column:
    return lookup(F.col("authority"), AUTHORITY_FACTOR, 0.5)


def proof_density() -> Column:
    return F.greatest(F.lit(0.25), F.least(F.lit(1.0), F.col("proofs") / 2.0))


def admissible() -> Column:
    """Of memory, not model-derived, contradicted, unverified or superseded; what comes from other sources always is."""
    good = (F.coalesce(F.col("authority"), F.lit("")) != "model_derived") & ~F.coalesce(F.col("verification"), F.lit("")).isin("contradicted", "unverified") & F.col("superseded_by").isNull()
    return (F.coalesce(F.col("source_class"), F.lit("")) != "memory") | good


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def compile_cover(items: DataFrame, budget: int, intent: str = "hybrid", request: str = "request_id", order: str = "item_id") -> DataFrame:
    """A minimal proof set of each request, then filler: request, item_id, stage, place, covers.

    Items come in ``order``; of the admissible ones with one claim key (or
    source, title and summary) the first counts. Weighted set cover: again and
    again the item with the most weight a token that covers an open goal, until
    goals or candidates end, or until an item does not fit, which ends it. What
    has none of the chosen keys (claim key, or source and title) is then taken
    by filler priority, in order, each item that still fits. Items of no tokens
    cover nothing but can be filler.

    An item covers the goal of its type alone, so of each goal as many
    candidates as there are goals are enough, however many there are: the others
    can only be passed over for keys already chosen. Of filler items of t tokens
    the first budget // t are enough, as once one of them does not fit no later
    one does. So no request's rows are cut, and a call has some budget * ln
    budget rows at most besides items of no tokens, which take no part in it.

    Nulls: a null authority counts half, a null type or source covers nothing, null tokens are
    none. Requests whose items are all inadmissible give no rows; nor do empty tables.
    """
    claim = F.col("claim_key").cast("string")
    short_key = F.concat_ws("\x01", F.col("source_class"), F.col("title") if "title" in items.columns else F.col("item_id").cast("string"))
    filler = F.coalesce(lookup(F.col("source_class"), _of(FILLER, intent), 0.0) * authority_factor() * freshness(), F.lit(0.0))
    able = items.where(admissible()).withColumns(
        {
            "tokens": F.coalesce(F.col("tokens").cast("long"), F.lit(0)), "_goal": covers(), "_weight": freshness() * authority_factor() * proof_density(), "_filler": filler,
            "_long": dedupe_key(items), "_key": F.coalesce(claim, short_key), "_order": F.col(order),
        }
    )
    per = lambda *by: Window.partitionBy(request, *by)
    first = F.row_number().over(per("_long").orderBy("_order", "item_id"))
    open_ = able.withColumn("_n", first).where((F.col("_n") == 1) & (F.col("tokens") > 0) & F.array_contains("goals", F.col("_goal")))
    best = (F.desc(F.col("_weight") / F.col("tokens")), F.asc("_order"), F.asc("item_id"))
    goals = len(GOAL_OF_TYPE)
    one = open_.withColumn("_n", F.row_number().over(per("_goal", "_key").orderBy(*best))).where("_n = 1")
    few = one.withColumn("_n", F.row_number().over(per("_goal").orderBy(*best))).where(F.col("_n") <= goals).select(request, "item_id", "_goal", "_key", "_weight", "tokens", "_order")
    kind = dict(items.dtypes)

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(rate=frame["_weight"] / frame["tokens"]).sort_values(["rate", "_order", "item_id"], ascending=[False, True, True], kind="stable")
        used, done, keys, out = 0, set(), set(), []
        while True:
            r = next((r for r in frame.to_dict("records") if r["_goal"] not in done and r["_key"] not in keys), None)
            if r is None or used + r["tokens"] > budget:
                break
            used += r["tokens"]
            done.add(r["_goal"])
            keys.add(r["_key"])
            out.append((r[request], r["item_id"], len(out), r["_goal"], r["_key"], used))
        return pd.DataFrame(out, columns=[request, "item_id", "place", "covers", "_key", "used"])

    cover = cut(few.groupBy(request).applyInPandas(choose, f"{request} {kind[request]}, item_id {kind['item_id']}, place int, covers string, _key string, used long"))
    spent = cover.groupBy(request).agg(F.max("used").alias("_used"), F.count("*").cast("int").alias("_places"))
    rest = able.join(cover.select(request, "_key"), [request, "_key"], "left_anti")
    sort = (F.desc("_filler"), F.asc("_order"), F.asc("item_id"))
    none = rest.where("tokens = 0")
    some = rest.where((F.col("tokens") > 0) & (F.col("tokens") <= budget)).withColumn("_n", F.row_number().over(per("tokens").orderBy(*sort))).where(F.col("_n") <= F.floor(F.lit(budget) / F.col("tokens")))
    some = some.join(spent, request, "left").select(request, "item_id", "tokens", "_filler", "_order", F.coalesce("_used", F.lit(0)).alias("_used"))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_filler", "_order", "item_id"], ascending=[False, True, True], kind="stable")
        used, keep = int(frame["_used"].iloc[0]), []
        for t in frame["tokens"]:
            keep.append(used + t <= budget)
            used += t if keep[-1] else 0
        return frame.loc[keep, [request, "item_id", "_filler", "_order"]]

    order_kind = able.schema["_order"].dataType.simpleString()
    filled = some.groupBy(request).applyInPandas(fill, f"{request} {kind[request]}, item_id {kind['item_id']}, _filler double, _order {order_kind}")
    filled = filled.unionByName(none.select(request, "item_id", "_filler", "_order")).join(spent.select(request, "_places"), request, "left")
    placed = filled.withColumn("place", F.coalesce("_places", F.lit(0)) + F.row_number().over(per().orderBy(*sort)) - 1)
    both = cover.select(request, "item_id", F.lit("proof").alias("stage"), "place", "covers").unionByName(
        placed.select(request, "item_id", F.lit("filler").alias("stage"), F.col("place").cast("int"), F.lit(None).cast("string").alias("covers"))
    )
    return both


def proof_gaps(requests: DataFrame, chosen: DataFrame, request: str = "request_id") -> DataFrame:
    """Goals of each request that no chosen item covers."""
    got = chosen.where("covers is not null").groupBy(request).agg(F.collect_set("covers").alias("covered"))
    none = F.array().cast("array<string>")
    return requests.join(got, request, "left").select(request, F.array_sort(F.array_except("goals", F.coalesce("covered", none))).alias("gaps"))


def advice(items: DataFrame, intent: str = "hybrid", request: str = "request_id", requests: DataFrame | None = None) -> DataFrame:
    """unknowns and recommendations of each request, from what its items lack; ``requests`` names those without items too."""
    truth = is_truth(F.col("verification"), F.col("authority"))
    flags = items.groupBy(request).agg(
        F.bool_or(F.col("source_class") == "repository").alias("repo"), F.bool_or((F.col("source_class") == "memory") & truth).alias("truth"), F.bool_or(truth).alias("any_truth"),
        F.bool_or((F.col("source_class") == "conflict") | F.coalesce(F.col("verification") == "contradicted", F.lit(False))).alias("conflict"),
    )
    flags = flags.withColumn("some", F.lit(True))
    if requests is not None:
        flags = requests.select(request).distinct().join(flags, request, "left").na.fill(False)
    repo, own = F.col("repo"), F.col("truth")
    lack = {
        "repository_only": (~repo, "Repository knowledge was requested but no repository proof was retrieved."),
        "memory_only": (~own, "Continuity was requested but only low-confidence or summary-style memory was available."),
        "hybrid": (~repo | ~own, "Hybrid retrieval did not produce both repository proof and verified continuity claims."),
        "session_graph_only": (~F.col("some"), "Session history was requested but the session graph had no matching evidence."),
    }.get(intent, (F.lit(False), ""))
    unknowns = F.array(F.when(lack[0], lack[1]), F.when(F.col("conflict"), "Conflicting claims were retrieved and require verification."))
    asks_memory, asks_repo = F.lit(intent in ("memory_only", "hybrid")), F.lit(intent in ("repository_only", "hybrid"))
    steps = F.array(
        F.when(F.col("conflict"), "Resolve conflicting claims with the latest repository, tool, or test evidence."),
        F.when(asks_memory & ~F.col("any_truth"), "Promote explicit decisions, tasks, constraints, and verified fixes into claim memory instead of relying on summaries."),
        F.when(asks_repo & ~repo, "Refresh repository sync or query repository knowledge directly."),
    )
    return flags.select(request, F.array_compact(unknowns).alias("unknowns"), F.array_compact(steps).alias("recommended"))


def graph_items(nodes: DataFrame, source: str = "repository") -> DataFrame:
    """Graph nodes as context items: item_id, title, summary of what is known of each, tokens."""
    from loomspan.functions.text import estimate_tokens

    facts = [F.concat(F.lit("type "), "node_type"), F.concat(F.lit("in "), "source_file") if "source_file" in nodes.columns else None, F.concat(F.lit("from "), "source_type")]
    summary = F.concat_ws("; ", F.col("label"), *[f for f in facts if f is not None])
    return nodes.select(F.col("id").alias("item_id"), F.col("label").alias("title"), summary.alias("summary"), F.lit(source).alias("source_class"), estimate_tokens(summary).alias("tokens"))


def repository_items(nodes: DataFrame, query: str, paths: tuple[str, ...] = (), n: int = 10) -> DataFrame:
    """Context items of the nodes that answer a query, and of exactly named files."""
    from loomspan.operators.traverse import search_nodes

    found = search_nodes(nodes, query, n).select(*nodes.columns)
    named = nodes.where(F.col("id").isin(*[f"file:{p}" for p in paths])) if paths else nodes.limit(0)
    return graph_items(found.unionByName(named).dropDuplicates(["id"]))


def conflict_split(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits as memory items, and those with active conflicts or contradicted as conflict items."""
    bad = (F.coalesce(F.col("conflicts"), F.lit(0)) > 0) | (F.coalesce(F.col("verification"), F.lit("")) == "contradicted")
    kind = hits.withColumn("source_class", F.when(bad, "conflict").otherwise("memory"))
    return kind.where("source_class = 'memory'"), kind.where("source_class = 'conflict'")
