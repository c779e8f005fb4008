"""Claims: segments of events typed, gated, keyed and scored, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import claim_text, clip, contains_any
from loomspan.operators.events import event_text
from loomspan.schemas import lookup

# Cues of claim types, tried in this order.
CUES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("open_question", ("open question:", "question:", "unknown whether")),
    ("constraint", ("constraint:", "must ", "do not ", "should not ", "required", "fallback only")),
    ("decision", ("decision:", "decision update", "we decided", "policy:")),
    ("task", ("task:", "todo:", "next:", "follow up", "need to ", "continue ")),
    ("fix", ("fix:", "fixed", "resolved", "verified fix", "confirmed fix")),
)
ERROR_CUES = ("failed", "error", "exception", "bug:")
FACT_CUES = ("verified", "confirmed", "current truth")
DOUBT = ("hypothesis", "guess", "might be")
TASK_MARKS = ("task:", "todo:", "next:", "follow up", "continue ")
QUESTION_MARKS = ("open question:", "question:", "unknown whether", "?")
NEGATIVE = ("do not", "should not", "not ", "disabled", "rejected", "fallback only")
PREFIXES = (
    "decision:", "decision update:", "task:", "todo:", "next:", "constraint:", "open question:", "question:", "bug:", "fix:", "fact:",
)
TITLES = {
    "fact": "Fact", "decision": "Decision", "task": "Task", "constraint": "Constraint", "bug": "Bug", "fix": "Fix",
    "open_question": "Open question", "summary": "Summary", "implementation_detail": "Implementation detail",
    "change_log": "Change log", "risk": "Risk",
}
IMPORTANCE = {
    "decision": 0.92, "constraint": 0.92, "fix": 0.92, "task": 0.86, "bug": 0.86, "fact": 0.86, "open_question": 0.7,
    "implementation_detail": 0.74, "summary": 0.45, "risk": 0.45, "change_log": 0.45,
}
CONFIDENCE = {"verified": 0.9, "user_confirmed": 0.86, "inferred": 0.68, "contradicted": 0.24, "unverified": 0.2}
ROLES = {
    "decision": "durable_decision", "task": "active_task", "constraint": "constraint_guardrail", "fact": "project_fact",
    "bug": "known_bug", "fix": "verified_fix", "open_question": "open_question", "implementation_detail": "implementation_note",
    "summary": "summary_fallback", "change_log": "summary_fallback", "risk": "risk",
}
SOURCE_CLASSES = {k: k for k in ROLES} | {"summary": "session_summary", "change_log": "session_summary"}
# Event types by what they prove.
PROOFS = {
    "prompt": "user_confirmation", "annotation": "user_confirmation", "tool_result": "tool_result", "command": "tool_result",
    "file_change": "tool_result", "test_result": "test_result", "error": "test_result",
}
AUTHORITY_OF_PROOF = {"user_confirmation": "user_confirmed", "tool_result": "tool_verified", "test_result": "test_verified"}
MODEL_EVENTS = ("response", "agent_message", "reasoning", "turn_context")
SILENT_EVENTS = ("reasoning", "turn_context")


def segments(x: Column) -> Column:
    """Pieces between line ends, bars and spaced dashes, of 12 bytes or more, trimmed of blanks and bullets."""
    pieces = F.split(x, r"\n|\|| - ", -1)
    long = F.filter(F.transform(pieces, lambda s: F.trim(s)), lambda s: F.octet_length(s) >= 12)
    bare = F.transform(long, lambda s: F.trim(F.regexp_replace(s, "^[-*•]+|[-*•]+$", "")))
    return F.filter(bare, lambda s: s != "")


def claim_type(segment: Column, event: Column, exit_code: Column) -> Column:
    """The first rule whose cue occurs; null is no claim. A null event is a session's end summary."""
    low = F.lower(segment)
    out = F.when(contains_any(low, CUES[0][1]) | low.endswith("?"), CUES[0][0])
    for name, cues in CUES[1:]:
        out = out.when(contains_any(low, cues), name)
    wrong = F.coalesce(event == "error", F.lit(False)) | F.coalesce(exit_code != 0, F.lit(False)) | contains_any(low, ERROR_CUES)
    work = F.coalesce(event.isin("command", "tool_call", "tool_result", "file_change"), F.lit(False))
    return out.when(wrong, "bug").when(contains_any(low, FACT_CUES), "fact").when(work, "implementation_detail")


def proof_type(event: Column) -> Column:
    return F.when(event.isNull(), "summary").otherwise(lookup(event, PROOFS, "session_event"))


def authority(event: Column) -> Column:
    by_proof = lookup(proof_type(event), AUTHORITY_OF_PROOF, None)
    return F.when(event.isNull() | event.isin(*MODEL_EVENTS), "model_derived").otherwise(F.coalesce(by_proof, F.lit("session_derived")))


def verification(segment: Column, event: Column) -> Column:
    doubt = contains_any(F.lower(segment), DOUBT)
    proved = lookup(proof_type(event), {"user_confirmation": "user_confirmed", "tool_result": "verified", "test_result": "verified"}, "inferred")
    return F.when(doubt, "unverified").otherwise(proved)


def admitted(kind: Column, authority_: Column, verification_: Column, segment: Column, event: Column) -> Column:
    """Whether a claim may be believed: what its type needs of its verification and authority."""
    low = F.lower(segment)
    sure = verification_.isin("verified", "user_confirmed")
    own = authority_ != "model_derived"
    said = (verification_ == "inferred") & (authority_ == "session_derived")
    by_type = (
        F.when(kind.isin("decision", "constraint"), sure & own)
        .when(kind == "task", own & (sure | (said & contains_any(low, TASK_MARKS))))
        .when(kind == "open_question", own & (sure | (said & contains_any(low, QUESTION_MARKS))))
        .when(kind.isin("fact", "bug", "fix", "implementation_detail"), sure | authority_.isin("tool_verified", "test_verified", "user_confirmed"))
        .otherwise(False)
    )
    silent = F.coalesce(event.isin(*SILENT_EVENTS), F.lit(False))
    return F.coalesce(by_type & ~contains_any(low, DOUBT) & ~silent, F.lit(False))


def polarity(segment: Column) -> Column:
    return F.when(contains_any(F.lower(segment), NEGATIVE), "negative").otherwise("positive")


def bare_claim(segment: Column) -> Column:
    """Without the first prefix of the list that fits."""
    text = F.trim(segment)
    out = F.when(F.lit(False), text)
    for p in PREFIXES:
        out = out.when(F.lower(text).startswith(p), F.trim(F.substring(text, len(p) + 1, 1 << 20)))
    return out.otherwise(text)


def claim_title(kind: Column, segment: Column) -> Column:
    return F.concat(lookup(kind, TITLES, "Summary"), F.lit(": "), clip(bare_claim(segment), 96))


def claim_key(kind: Column, segment: Column, file_path: Column) -> Column:
    return F.concat_ws(":", kind, claim_text(F.coalesce(file_path, F.lit("global"))), claim_text(bare_claim(segment)))


def claim_subject(key: Column, session: Column) -> Column:
    """The key's second field, else the session, else global."""
    return F.coalesce(F.nullif(F.split_part(key, F.lit(":"), F.lit(2)), F.lit("")), session, F.lit("global"))


def importance(kind: Column, verification_: Column) -> Column:
    base = lookup(kind, IMPORTANCE, 0.45)
    weak = F.when(verification_ == "inferred", F.greatest(base - 0.12, F.lit(0.2))).when(verification_.isin("unverified", "contradicted"), F.greatest(base - 0.25, F.lit(0.1)))
    return F.round(weak.otherwise(base), 4)


def confidence(verification_: Column, from_summary: Column) -> Column:
    base = lookup(verification_, CONFIDENCE, 0.5)
    return F.round(F.when(from_summary, F.greatest(base - 0.08, F.lit(0.1))).otherwise(base), 4)


def derivation(kind: Column, from_summary: Column) -> Column:
    """What made a claim: its type's rule, or a session's summary."""
    plain = F.when(kind.isin("summary", "risk", "change_log"), "claim").otherwise(F.concat(kind, F.lit("_claim")))
    return F.when(from_summary, "summary_claim").otherwise(plain)


def atomic_claims(events: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Claims of events and of sessions' end summaries, one for each segment that has a type.

    events: the canonical columns, with ``episode`` if segmented. summaries:
    session_id, summary, ended_at. Silent events give none. Of equal drafts (by
    type, episode, key, title) the first stays; then at most one a session,
    derivation, episode and type is kept, in draft order.
    """
    from_events = events.where(~F.col("event_type").isin(*SILENT_EVENTS)).select(
        "session_id", "ordinal", "created_at", "event_id", "event_type", "exit_code", "file_path",
        (F.col("episode") if "episode" in events.columns else F.lit(None).cast("long")).alias("episode"),
        F.posexplode(segments(event_text())).alias("pos", "segment"),
    )
    if summaries is not None:
        ends = summaries.select(
            "session_id", F.lit(1 << 62).alias("ordinal"), F.col("ended_at").alias("created_at"), F.lit(None).cast("string").alias("event_id"),
            F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("int").alias("exit_code"), F.lit(None).cast("string").alias("file_path"),
            F.lit(None).cast("long").alias("episode"), F.posexplode(segments(F.col("summary"))).alias("pos", "segment"),
        )
        from_events = from_events.unionByName(ends)
    e, s = F.col("event_type"), F.col("segment")
    typed = from_events.withColumn("claim_type", claim_type(s, e, F.col("exit_code"))).where("claim_type is not null")
    typed = typed.withColumns({"proof_type": proof_type(e), "authority": authority(e), "verification": verification(s, e)})
    k, summary = F.col("claim_type"), e.isNull()
    drafts = typed.withColumns({
        "admitted": admitted(k, F.col("authority"), F.col("verification"), s, e), "polarity": polarity(s), "title": claim_title(k, s),
        "claim_key": claim_key(k, s, F.col("file_path")), "importance": importance(k, F.col("verification")),
        "confidence": confidence(F.col("verification"), summary), "derivation": derivation(k, summary),
        "source_class": lookup(k, SOURCE_CLASSES, None), "ranking_role": lookup(k, ROLES, None),
    }).withColumn("subject", claim_subject(F.col("claim_key"), F.col("session_id")))
    once = Window.partitionBy("session_id", "claim_type", "episode", "claim_key", "title", "segment").orderBy("ordinal", "pos")
    kept = Window.partitionBy("session_id", "derivation", "episode", "claim_type").orderBy(F.desc("admitted"), "ordinal", "pos")
    drafts = drafts.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    return drafts.withColumn("persisted", F.col("admitted") & (F.row_number().over(kept) == 1)).drop("_n")


def reflections(episodes: DataFrame, key: str = "session_id") -> DataFrame:
    """A reflection of each session with two episodes or more: its work mode, its mix, and whether debugging is left open.

    Debugging is open if the last episode that is not conversation is debugging.
    """
    n = lambda t: F.count_if(F.col("episode_type") == t)
    last = F.array_sort(F.collect_list(F.struct("episode", F.left("summary", F.lit(120)).alias("summary"))))
    rolled = episodes.groupBy(key).agg(
        F.count("*").alias("episodes"), n("conversation").alias("conversation"), n("implementation").alias("implementation"), n("debugging").alias("debugging"),
        F.max_by(F.when(F.col("episode_type") != "conversation", F.col("episode_type")), F.when(F.col("episode_type") != "conversation", F.col("episode"))).alias("last_work"),
        last.alias("all"),
    ).where("episodes >= 2")
    top = F.greatest("conversation", "implementation", "debugging")
    mode = F.when(F.col("conversation") == top, "conversation").when(F.col("implementation") == top, "implementation").otherwise("debugging")
    risk = F.coalesce(F.col("last_work") == "debugging", F.lit(False))
    recent = F.array_join(F.transform(F.slice("all", -F.least(F.size("all"), F.lit(3)), F.lit(3)), lambda x: x["summary"]), " || ")
    content = F.concat_ws(
        "\n", F.concat(F.lit("Dominant work mode: "), F.col("mode")),
        F.concat(*[p for t in ("conversation", "implementation", "debugging") for p in (F.lit(f"{'Episode mix: ' if t == 'conversation' else ', '}{t}="), F.col(t).cast("string"))]),
        F.concat(F.lit("Recent episode summaries: "), recent),
        F.when(F.col("risk"), "Risk: session ended with unresolved debugging context.").otherwise("Risk: no unresolved debugging signal detected."),
    )
    return rolled.withColumns({"mode": mode, "risk": risk}).select(
        key, F.when(F.col("risk"), "risk").otherwise("summary").alias("memory_type"), F.col("mode").alias("dominant_type"), F.col("risk").alias("unresolved_risk"),
        F.when(F.col("risk"), "Session reflection risk").otherwise("Session reflection summary").alias("title"), F.left(content, F.lit(3000)).alias("content"),
        F.when(F.col("risk"), 0.82).otherwise(0.68).alias("importance"), F.lit(0.72).alias("confidence"),
    )


def session_memories(events: DataFrame, episodes: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Memories of each session: its claims, or, where it has none, a rollup, a reflection and its episodes."""
    claims = atomic_claims(events, summaries).select("session_id", F.col("claim_type").alias("memory_type"), "title", F.col("segment").alias("content"), "importance", "confidence", "admitted")
    quiet = episodes.join(claims.select("session_id").distinct(), "session_id", "left_anti")
    rollup = quiet.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("episode", F.concat_ws(": ", "title", "summary").alias("t")))).alias("all")).select(
        "session_id", F.lit("summary").alias("memory_type"), F.lit("Session summary").alias("title"), F.left(F.array_join("all.t", "\n"), F.lit(3000)).alias("content"),
        F.lit(0.75).alias("importance"), F.lit(0.8).alias("confidence"), F.lit(False).alias("admitted"),
    )
    if summaries is not None:
        given = summaries.select("session_id", F.nullif(F.trim("summary"), F.lit("")).alias("given")).where("given is not null").groupBy("session_id").agg(F.max("given").alias("given"))
        rollup = rollup.join(given, "session_id", "left").withColumn("content", F.coalesce("given", "content")).drop("given")
    reflected = reflections(quiet).select("session_id", "memory_type", "title", "content", "importance", "confidence", F.lit(False).alias("admitted"))
    each = quiet.select("session_id", F.lit("summary").alias("memory_type"), "title", F.col("summary").alias("content"), F.lit(0.6).alias("importance"), F.lit(0.7).alias("confidence"), F.lit(False).alias("admitted"))
    return claims.unionByName(rollup.where("content <> ''")).unionByName(reflected).unionByName(each)


def is_current(historical: bool = False, prefix: str = "") -> Column:
    """Admitted, not superseded, not closed, not contradicted, not archived or rejected; rows without a claim pass."""
    if historical:
        return F.lit(True)
    c = lambda name: F.col(prefix + name)
    return c("claim_id").isNull() | (
        c("admitted") & c("superseded_by").isNull() & c("valid_to").isNull()
        & (F.coalesce(c("verification"), F.lit("")) != "contradicted") & ~F.coalesce(c("governance"), F.lit("active")).isin("archived", "rejected")
    )


def claims_as_of(claims: DataFrame, at: Column) -> DataFrame:
    """Claims valid at an instant: from valid_from on, and before valid_to."""
    return claims.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def is_truth(verification_: Column, authority_: Column) -> Column:
    strong = F.coalesce(authority_.isin("repository", "tool_verified", "test_verified", "user_confirmed"), F.lit(False))
    return F.coalesce(verification_.isin("verified", "user_confirmed"), F.lit(False)) | strong


def govern(claims: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply governance decisions (claim_id, state, decided_at), latest last; returns claims and the history of changes."""
    latest = decisions.groupBy("claim_id").agg(F.max_by("state", "decided_at").alias("_state"))
    after = claims.join(latest, "claim_id", "left").withColumn("governance", F.coalesce("_state", "governance")).drop("_state")
    w = Window.partitionBy("claim_id").orderBy("decided_at")
    history = decisions.join(claims.select("claim_id", "governance"), "claim_id").select(
        "claim_id", F.coalesce(F.lag("state").over(w), F.col("governance")).alias("previous_state"), "state", "decided_at"
    )
    return after, history
