"""Schemas and fixed domains of the canonical tables."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

EVENTS = (
    "session_id string, event_id string, idempotency_key string, ordinal long, event_type string, message string, command string, "
    "tool_name string, file_path string, exit_code int, lines_added int, lines_deleted int, metadata map<string,string>, created_at timestamp"
)
CLAIMS = (
    "claim_id string, memory_id string, project_id string, claim_type string, claim_key string, subject string, polarity string, "
    "authority string, verification string, admitted boolean, governance string, valid_from timestamp, valid_to timestamp, "
    "superseded_by string, created_at timestamp"
)
NODES = "id string, label string, node_type string, source_type string, source_id string, metadata map<string,string>"
EDGES = "source string, target string, relation string, evidence string, weight double, metadata map<string,string>"

# Fixed domains.
EVENT_TYPES = (
    "prompt", "response", "tool_call", "tool_result", "file_change", "command", "test_result", "summary", "error",
    "annotation", "reasoning", "turn_context", "agent_message",
)
MEMORY_TYPES = (
    "fact", "decision", "task", "constraint", "bug", "fix", "open_question", "summary", "implementation_detail", "change_log", "risk",
)
AUTHORITY = ("repository", "user_confirmed", "tool_verified", "test_verified", "session_derived", "model_derived")
VERIFICATION = ("verified", "user_confirmed", "inferred", "contradicted", "unverified")
GOVERNANCE = ("active", "pinned", "archived", "rejected")
INTENTS = ("none", "memory_only", "repository_only", "session_graph_only", "hybrid")
EVIDENCE_RANK = {"extracted": 3, "inferred": 2, "ambiguous": 1}


def lookup(x: Column, table: dict[str, float | int | str], default: float | int | str | None) -> Column:
    """A value from a small fixed table, as a map literal."""
    entries = F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(entries, x), F.lit(default))


def known(x: Column, domain: tuple[str, ...], otherwise: str) -> Column:
    """A value of the domain, else the fallback."""
    return F.when(x.isin(*domain), x).otherwise(F.lit(otherwise))
