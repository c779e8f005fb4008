"""The engine's tools by name: what each takes, and calls by name with a default project."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.api import Engine, RequestError, need
from loomspan.operators import ranking, traverse
from loomspan.schemas import EVENT_TYPES, EVENTS, GOVERNANCE, INTENTS

LAYERS = ("repository", "session")
QUERIES = ("hub_nodes", "shortest_path", "neighbors", "communities", "search", "goal_directed")


@dataclass(frozen=True)
class Arg:
    """An argument: its type, whether it must be there, the values it may have, and its range."""

    kind: type
    required: bool = False
    among: tuple = ()
    least: int | None = None
    most: int | None = None

    def check(self, name: str, value: object) -> None:
        need(isinstance(value, self.kind) and not (self.kind is int and isinstance(value, bool)), f"{name} must be {self.kind.__name__}")
        need(not self.among or value in self.among, f"{name} must be one of {', '.join(map(str, self.among))}")
        size = len(value) if isinstance(value, list | str) else value
        need(self.least is None or size >= self.least, f"{name} is below {self.least}")
        need(self.most is None or size <= self.most, f"{name} is above {self.most}")

    def schema(self) -> dict:
        names = {str: "string", int: "integer", bool: "boolean", list: "array", dict: "object", datetime: "string"}
        out: dict = {"type": names[self.kind]} | ({"format": "date-time"} if self.kind is datetime else {}) | ({"enum": list(self.among)} if self.among else {})
        low, high = {str: ("minLength", "maxLength"), list: ("minItems", "maxItems")}.get(self.kind, ("minimum", "maximum"))
        return out | ({low: self.least} if self.least is not None else {}) | ({high: self.most} if self.most is not None else {})


def _must(kind: type, **rest) -> Arg:
    return Arg(kind, True, **rest)


_PROVIDER, _LAYER, _PACK = _must(str, least=1, most=64), Arg(str, among=LAYERS), {"objective": _must(str, least=1), "retrievalIntent": Arg(str, among=INTENTS), "maxTokenBudget": _must(int, least=1, most=64000)}

#: Name to what the tool does and takes; all but health_check also take a projectId.
TOOLS: dict[str, tuple[str, dict[str, Arg]]] = {
    "session_start": ("Start a session, or take it up again.", {"provider": _PROVIDER, "externalSessionId": _must(str, least=1), "at": _must(datetime), "branch": Arg(str)}),
    "session_event_append": ("Store an event of an active session.", {"sessionId": _must(str), "eventId": _must(str), "idempotencyKey": _must(str), "eventType": _must(str, among=EVENT_TYPES), "eventTime": _must(datetime), "payload": _must(dict), "ordinal": Arg(int)}),
    "session_end": ("End a session.", {"sessionId": _must(str), "at": _must(datetime)}),
    "repository_sync": ("Replace the graph parts of changed and removed files.", {"files": _must(list), "removedPaths": Arg(list), "at": _must(datetime)}),
    "health_check": ("Whether the store can be read.", {}),
    "mem_search": ("Search memories by words and signals.", {"query": _must(str), "types": Arg(list), "branch": Arg(str), "sessionId": Arg(str), "limit": Arg(int, least=1, most=50)}),
    "context_build": ("Pack context within a budget.", {"provider": _PROVIDER, **_PACK}),
    "context_compile_v2": ("The smallest proof set that covers an objective's goals.", {"provider": _PROVIDER, **_PACK}),
    "graph_snapshot": ("The heads of all graphs.", {}),
    "knowledge_graph_export": ("A graph as node-link lines.", {"layer": _LAYER}),
    "knowledge_report": ("A report of a graph.", {"layer": Arg(str, among=(*LAYERS, "unified"))}),
    "knowledge_query": ("Ask a graph.", {"query": _must(str, among=QUERIES), "nodeId": Arg(str), "targetNodeId": Arg(str), "text": Arg(str), "depth": Arg(int, least=1, most=5), "layer": _LAYER}),
    "knowledge_communities": ("Communities of a graph with their figures.", {"layer": _LAYER}),
    "memory_get_batch": ("Several memories by id.", {"ids": _must(list, least=1, most=20)}),
    "memory_get": ("A memory by id.", {"id": _must(str)}),
    "claim_govern": ("Change the governance state of a claim.", {"claimId": _must(str), "newState": _must(str, among=GOVERNANCE), "at": _must(datetime)}),
}


def definitions() -> list[dict]:
    """The tools as JSON schemas."""
    project = {"projectId": {"type": "string"}}
    out = []
    for name, (said, args) in TOOLS.items():
        properties = {k: a.schema() for k, a in args.items()} | (project if name != "health_check" else {})
        out.append({"name": name, "description": said, "inputSchema": {"type": "object", "properties": properties, "required": [k for k, a in args.items() if a.required]}})
    return out


def validated(name: str, args: dict) -> dict:
    """The arguments, checked; unknown tools and broken arguments are request errors."""
    need(name in TOOLS, f"unknown tool {name}")
    for key, arg in TOOLS[name][1].items():
        need(not arg.required or args.get(key) is not None, f"{name} needs {key}")
        if args.get(key) is not None:
            arg.check(key, args[key])
    return args


def call(engine: Engine, name: str, args: dict, memories: DataFrame | None = None, claims: DataFrame | None = None, items: DataFrame | None = None) -> object:
    """Run a tool by name. A projectId among the arguments replaces the engine's own.

    memories, claims and items are what search, governance and context go by;
    tools that need one and have none are request errors. Events are stored with
    ``ordinal`` 0 where none is given. Results are DataFrames, dicts or text.
    """
    args = validated(name, args)
    if args.get("projectId"):
        engine = replace(engine, project=args["projectId"])
    return _RUN[name](engine, args, {"memories": memories, "claims": claims, "items": items})


def _given(given: dict, name: str) -> DataFrame:
    if given[name] is None:
        raise RequestError(f"the tool needs {name}")
    return given[name]


def _append(engine: Engine, a: dict, given: dict) -> DataFrame:
    p = a["payload"]
    row = (a["sessionId"], a["eventId"], a["idempotencyKey"], a.get("ordinal", 0), a["eventType"], *[p.get(k) for k in ("message", "command", "toolName", "filePath", "exitCode", "linesAdded", "linesDeleted")], None, a["eventTime"])
    return engine.append_events(engine.store.spark.createDataFrame([row], EVENTS))


def _search(engine: Engine, a: dict, given: dict) -> DataFrame:
    request = ranking.Request(query=a["query"], types=tuple(a.get("types") or ()), branch=a.get("branch"), session_id=a.get("sessionId"))
    return engine.search(_given(given, "memories"), request, a.get("limit") or 10)


def _query(engine: Engine, a: dict, given: dict) -> DataFrame:
    options = {"node": a.get("nodeId"), "source": a.get("nodeId"), "target": a.get("targetNodeId"), "text": a.get("text") or "", "depth": a.get("depth") or 1}
    need(a["query"] not in ("neighbors", "shortest_path") or bool(options["node"]), f"{a['query']} needs nodeId")
    need(a["query"] != "shortest_path" or bool(options["target"]), "shortest_path needs targetNodeId")
    layer = a.get("layer") or "session"
    if a["query"] == "communities":
        return engine.communities(layer)
    return traverse.query(a["query"], *engine.graph(layer), **options)


def _govern(engine: Engine, a: dict, given: dict) -> tuple[DataFrame, DataFrame]:
    table = _given(given, "claims")
    decision = engine.store.spark.createDataFrame([(a["claimId"], a["newState"], a["at"])], "claim_id string, state string, decided_at timestamp")
    return engine.govern(table, decision)


def _report(engine: Engine, a: dict, given: dict) -> str:
    return engine.unified_report() if a.get("layer") == "unified" else engine.report(a.get("layer") or "session")


_RUN: dict[str, Callable[[Engine, dict, dict], object]] = {
    "session_start": lambda e, a, g: e.session_start(a["externalSessionId"], a["provider"], a["at"], a.get("branch")),
    "session_event_append": _append,
    "session_end": lambda e, a, g: e.session_end(a["sessionId"], a["at"]),
    "repository_sync": lambda e, a, g: e.repository_sync(a["files"], a.get("removedPaths") or [], a["at"]),
    "health_check": lambda e, a, g: e.health(),
    "mem_search": _search,
    "context_build": lambda e, a, g: e.context_build(_given(g, "items"), a["maxTokenBudget"], a.get("retrievalIntent") or "hybrid"),
    "context_compile_v2": lambda e, a, g: e.context_compile(_given(g, "items"), a["objective"], a["maxTokenBudget"], a.get("retrievalIntent") or "hybrid"),
    "graph_snapshot": lambda e, a, g: e.store.heads(),
    "knowledge_graph_export": lambda e, a, g: e.export(a.get("layer") or "session"),
    "knowledge_report": _report,
    "knowledge_query": _query,
    "knowledge_communities": lambda e, a, g: e.communities(a.get("layer") or "session"),
    "memory_get_batch": lambda e, a, g: e.memory_get(_given(g, "memories"), a["ids"]),
    "memory_get": lambda e, a, g: e.memory_get(_given(g, "memories"), [a["id"]]),
    "claim_govern": _govern,
}
