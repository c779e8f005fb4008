"""Session events: canonical text, classes, episodes, signals, relationships, idempotent appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.text import clip, contains_any, error_signature
from loomspan.schemas import EVENT_TYPES

# Names that providers use for event types.
EVENT_ALIASES = {
    "user": "prompt", "user_message": "prompt", "user_prompt": "prompt", "assistant": "response", "assistant_message": "response",
    "function_call": "tool_call", "tool_use": "tool_call", "custom_tool_call": "tool_call", "function_call_output": "tool_result",
    "custom_tool_call_output": "tool_result", "patch": "file_change", "edit": "file_change", "shell": "command", "exec_command": "command",
    "test": "test_result", "system": "turn_context", "thinking": "reasoning",
}
WORK = ("command", "tool_call", "tool_result", "file_change")


def event_type(raw: Column) -> Column:
    """A canonical event type of a provider's name; unknown names are annotations."""
    from loomspan.schemas import lookup

    name = F.regexp_replace(F.lower(F.trim(raw)), "[ -]", "_")
    return F.when(name.isin(*EVENT_TYPES), name).otherwise(lookup(name, EVENT_ALIASES, "annotation"))


def event_text() -> Column:
    """Message, command, tool and file, trimmed, those that are not empty, joined."""
    parts = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("message", "command", "tool_name", "file_path")]
    return F.concat_ws(" | ", *parts)


def event_class() -> Column:
    """debugging, implementation or conversation."""
    text = F.lower(event_text())
    wrong = (F.col("event_type") == "error") | F.coalesce(F.col("exit_code") != 0, F.lit(False)) | contains_any(text, ("failed", "error", "exception"))
    work = F.col("event_type").isin(*WORK) | text.contains("apply_patch")
    return F.when(wrong, "debugging").when(work, "implementation").otherwise("conversation")


def provider_id(x: Column) -> Column:
    """Lower case without white space around it; null unless 1 to 64 of a-z, 0-9, ., _ and -."""
    name = F.lower(F.btrim(x, F.lit(" \t\n\v\f\r")))
    return F.when(name.rlike(r"\A[a-z0-9._-]{1,64}\z"), name)


def episodes_of(events: DataFrame, kind: Column | None = None, gap_seconds: int = 900, cap: int = 8, key: str = "session_id", order: tuple[str, ...] = ("created_at", "ordinal")) -> DataFrame:
    """``events`` with ``episode_type`` and ``episode``, from 1 in each session.

    A new episode starts where the class changes, after a gap of more than
    ``gap_seconds`` whole seconds, or when the current one has ``cap`` events.
    The cap counts from the last start, and between class changes and gaps only
    the cap starts episodes, so within a run of those it is a division of the
    row number: three windows over one partitioning and order, one shuffle.
    """
    w = Window.partitionBy(key).orderBy(*order)
    typed = events.withColumn("episode_type", event_class() if kind is None else kind)
    whole = F.floor((F.unix_micros(F.col("created_at")) - F.unix_micros(F.lag("created_at").over(w))) / 1_000_000)
    fresh = (F.col("episode_type") != F.lag("episode_type").over(w)) | (whole > gap_seconds)
    runs = typed.withColumn("_fresh", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("_run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.row_number().over(Window.partitionBy(key, "_run").orderBy(*order)) - 1
    chunks = runs.withColumn("_start", ((nth % cap) == 0).cast("int"))
    return chunks.withColumn("episode", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_fresh", "_run", "_start")


def materialise_episodes(events: DataFrame, key: str = "session_id") -> DataFrame:
    """One row an episode: ordinal, type, title, summary, times, event types in first-seen order, event ids."""
    line = F.struct("created_at", "ordinal", event_text().alias("text"), "event_type", "event_id")
    grouped = events.groupBy(key, "episode", "episode_type").agg(
        F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"), F.count("*").alias("events"), F.array_sort(F.collect_list(line)).alias("lines")
    )
    texts = F.filter(F.transform("lines", lambda x: x["text"]), lambda t: t != "")
    return grouped.select(
        key, "episode", "episode_type", "started_at", "ended_at", "events",
        F.concat(F.lit("Episode "), F.col("episode").cast("string"), F.lit(": "), F.col("episode_type"), F.lit(" - "), clip(F.coalesce(F.get(texts, F.lit(0)), F.lit("")), 80)).alias("title"),
        F.left(F.array_join(texts, "\n"), F.lit(3000)).alias("summary"),
        F.array_distinct(F.transform("lines", lambda x: x["event_type"])).alias("event_types"),
        F.transform("lines", lambda x: x["event_id"]).alias("provenance_event_ids"),
    )


def session_signals(events: DataFrame, key: str = "session_id") -> DataFrame:
    """Distinct trimmed file paths and error signatures of each session."""
    path = F.nullif(F.trim("file_path"), F.lit(""))
    wrong = (F.col("event_type") == "error") | F.coalesce(F.col("exit_code") != 0, F.lit(False))
    signature = F.when(wrong, F.nullif(error_signature(event_text()), F.lit("")))
    return events.groupBy(key).agg(F.sort_array(F.collect_set(path)).alias("files"), F.sort_array(F.collect_set(signature)).alias("errors"))


def relationship_weight(same_branch: Column, shared_files: Column, shared_errors: Column) -> Column:
    """Weight of two sessions' relation, or null below 0.35."""
    weight = F.when(same_branch, 0.35).otherwise(0.0) + F.least(F.lit(0.3), shared_files * 0.15) + F.least(F.lit(0.3), shared_errors * 0.15)
    return F.when(F.round(weight, 9) >= 0.35, F.round(F.least(F.lit(1.0), weight), 4))


def session_edges(signals: DataFrame, recent: int = 20, key: str = "session_id", project: str = "project_id") -> DataFrame:
    """Related sessions, each with its ``recent`` predecessors in the project; ends in canonical order.

    signals: key, project, branch, ended_at, files, errors. The block of
    predecessors is a window frame, so the candidates are bounded per session
    and no pair join is made.
    """
    before = Window.partitionBy(project).orderBy("ended_at", key).rowsBetween(-recent, -1)
    priors = signals.withColumn("prior", F.collect_list(F.struct(F.col(key).alias("id"), "branch", "files", "errors")).over(before))
    pairs = priors.select(key, project, "branch", "files", "errors", F.explode("prior").alias("p"))
    same = F.coalesce((F.col("branch") == F.col("p.branch")) & (F.col("branch") != ""), F.lit(False))
    files, errors = F.size(F.array_intersect("files", "p.files")), F.size(F.array_intersect("errors", "p.errors"))
    scored = pairs.select(
        F.least(F.col(key), F.col("p.id")).alias("source"), F.greatest(F.col(key), F.col("p.id")).alias("target"), F.col(project),
        F.when(same, "same_branch").otherwise("related_to").alias("relation"), relationship_weight(same, files, errors).alias("weight"),
    )
    return scored.where("weight is not null")


def append_once(stored: DataFrame, batch: DataFrame, order: str = "position", session: str = "session_id") -> DataFrame:
    """The rows of ``batch`` with ``duplicate``: true where a key is stored already or came before in the batch.

    Two keys are unique in a session: idempotency_key and event_id.
    """
    marked = batch
    for k in ("idempotency_key", "event_id"):
        first = F.row_number().over(Window.partitionBy(session, k).orderBy(order)) > 1
        seen = stored.select(session, k).distinct().withColumn(f"_seen_{k}", F.lit(True))
        marked = marked.withColumn(f"_again_{k}", first & F.col(k).isNotNull()).join(seen, [session, k], "left")
    flags = [F.coalesce(F.col(f"{p}_{k}"), F.lit(False)) for p in ("_again", "_seen") for k in ("idempotency_key", "event_id")]
    duplicate = flags[0] | flags[1] | flags[2] | flags[3]
    return marked.withColumn("duplicate", duplicate).select(*batch.columns, "duplicate")


def merge_staged(stored: DataFrame, staged: DataFrame, order: str = "position") -> DataFrame:
    """Stored events and those of a staging table whose keys are neither stored nor staged before: a bulk load in one merge."""
    return stored.unionByName(append_once(stored, staged, order).where("not duplicate").select(*stored.columns))


def turn_ids(events: DataFrame, key: str = "session_id", order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """``turn``: counts turn_context events where a session has any, else prompts; 0 before the first."""
    whole = Window.partitionBy(key)
    running = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marker = F.when(F.max((F.col("event_type") == "turn_context").cast("int")).over(whole) == 1, "turn_context").otherwise("prompt")
    return events.withColumn("turn", F.sum((F.col("event_type") == marker).cast("int")).over(running).cast("long"))
