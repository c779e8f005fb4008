from datetime import datetime, timedelta

import pytest

from loomspan import tools
from loomspan.api import Engine, RequestError
from loomspan.operators.ranking import Request
from loomspan.plans import report
from loomspan.sources.adapters import memories, order_graph
from loomspan.sources.store import Store, id_map_faults, node_link_document, normalised_maps

T0 = datetime(2025, 1, 1)
EVENTS = "session_id string, event_id string, idempotency_key string, ordinal long, event_type string, message string, command string, tool_name string, file_path string, exit_code int, created_at timestamp"


def test_sessions_events_and_graphs(spark, sf, tmp_path):
    engine = Engine(Store(spark, str(tmp_path / "store")))
    with pytest.raises(RequestError):
        engine.session_start("s", "no such provider!", T0)
    engine.session_start("s", "CLI", T0, "main")
    batch = spark.createDataFrame([("s", "e1", "k1", 1, "prompt", "Decision: we keep one table", None, None, None, None, T0), ("s", "e2", "k1", 2, "prompt", "again", None, None, None, None, T0), ("gone", "e3", "k3", 3, "prompt", "x", None, None, None, None, T0)], EVENTS)
    got = {r.event_id: (r.duplicate, r.accepted) for r in engine.append_events(batch).collect()}
    assert got == {"e1": (False, True), "e2": (True, False), "e3": (False, False)}
    assert all(r.duplicate or not r.accepted for r in engine.append_events(batch).collect())
    engine.session_end("s", T0 + timedelta(hours=1))
    assert [(r.status, r.provider, r.branch) for r in engine.sessions().collect()] == [("completed", "cli", "main")]
    parts = engine.derive()
    assert parts["memories"].where("memory_type = 'decision'").count() == 1 and parts["nodes"].count() > 0
    nodes, edges = order_graph(spark, sf)
    engine.build_graph("repository", "one", nodes, edges, T0)
    engine.build_graph("repository", "two", nodes.limit(5), edges, T0 - timedelta(days=1))
    assert engine.graph("repository")[0].count() == nodes.count()
    assert engine.graph_query("repository", "neighbors", node="nation:3", depth=1).count() > 1
    assert engine.report("repository").startswith("# Knowledge graph") and engine.export("repository").count() == nodes.count() + edges.count()
    assert '"nodes"' in node_link_document(nodes, edges)
    with pytest.raises(RequestError):
        engine.graph("session")


def test_tools_by_name(spark, sf, tmp_path):
    """Every tool runs by name, with a default project, and refuses broken arguments."""
    engine = Engine(Store(spark, str(tmp_path / "tools")), "p1")
    run = lambda name, args, **given: tools.call(engine, name, args, **given)
    assert len(tools.definitions()) == 16 and all(d["inputSchema"]["type"] == "object" for d in tools.definitions())
    for name, args in (("nothing", {}), ("session_start", {"provider": "cli"}), ("knowledge_query", {"query": "odd"}), ("memory_get_batch", {"ids": []}), ("mem_search", {"query": "x", "limit": 99}), ("mem_search", {"query": "x"}), ("knowledge_query", {"query": "neighbors"})):
        with pytest.raises(RequestError):
            run(name, args)
    run("session_start", {"provider": "cli", "externalSessionId": "s", "at": T0})
    event = {"sessionId": "s", "eventId": "e", "idempotencyKey": "k", "eventType": "prompt", "eventTime": T0, "payload": {"message": "hello"}}
    assert [r.accepted for r in run("session_event_append", event).collect()] == [True] and [r.accepted for r in run("session_event_append", event).collect()] == [False]
    run("session_end", {"sessionId": "s", "at": T0 + timedelta(hours=1)})
    files = [{"path": "a/main.py", "hash": "1", "content": "import b\ndef run():\n    helper()\n# TODO: mend this\n"}, {"path": "a/b.py", "hash": "2", "content": "def helper():\n    pass\n"}, {"path": "node_modules/x.js", "hash": "3", "content": "x"}]
    nodes, _ = run("repository_sync", {"files": files, "at": T0})
    assert {r.id for r in nodes.where("node_type = 'file'").collect()} == {"file:a/main.py", "file:a/b.py"}
    nodes, _ = run("repository_sync", {"files": [{"path": "a/c.py", "hash": "4", "content": "class C:\n    pass\n"}], "removedPaths": ["a/b.py"], "at": T0 + timedelta(days=1)})
    assert {r.id for r in nodes.where("node_type = 'file'").collect()} == {"file:a/main.py", "file:a/c.py"}
    assert run("knowledge_query", {"query": "search", "text": "main.py", "layer": "repository"}).first().id == "file:a/main.py"
    assert run("knowledge_query", {"query": "communities", "layer": "repository"}).count() == run("knowledge_communities", {"layer": "repository"}).count() > 0
    assert run("graph_snapshot", {}).count() == 1 and run("knowledge_graph_export", {"layer": "repository"}).count() > 3
    assert "### Architectural Hubs" in run("knowledge_report", {"layer": "unified"}) and run("knowledge_report", {"layer": "repository"}).startswith("# ")
    made = engine.save_artifacts("repository", spark.createDataFrame([("a/main.py", "1")], "path string, hash string"))
    assert [m.rsplit("/", 1)[1] for m in made] == ["node_link", "manifest", "report", "page"] and all(engine.store.exists(m) for m in made)
    assert engine.store.read(made[0]).count() == run("knowledge_graph_export", {"layer": "repository"}).count() and "&lt;" not in engine.store.read(made[2]).first().body
    assert run("health_check", {})["project"] == "p1" and "events" in run("health_check", {})["tables"]
    with pytest.raises(RequestError):
        run("knowledge_report", {"layer": "repository", "projectId": "other"})
    m = memories(spark, sf).drop("lexical_score", "semantic_score")
    assert run("mem_search", {"query": "the or der or queque", "limit": 3}, memories=m).count() <= 3
    assert [r.id for r in run("memory_get", {"id": "7"}, memories=m).collect()] == [7] and run("memory_get_batch", {"ids": [1, 2]}, memories=m).count() == 2
    after, history = run("claim_govern", {"claimId": "3", "newState": "archived", "at": T0}, claims=m.select("claim_id", "governance"))
    assert after.where("claim_id = '3' and governance = 'archived'").count() == 1 and history.count() == 1
    items = m.limit(40).selectExpr("'r' request_id", "id item_id", "'memory' source_class", "memory_type", "claim_key", "title", "summary", "verification", "authority", "50 tokens", "valid_to", "superseded_by", "1 proofs")
    pack = {"provider": "cli", "objective": "fix the bug", "maxTokenBudget": 200}
    assert 0 < run("context_build", pack, items=items)[0].count() <= 4 and run("context_compile_v2", pack, items=items)[0].count() <= 4
    for compiled in (False, True):
        one = engine.context_for(m.limit(80), "queque or main.py helper", 2000, now=datetime(2026, 1, 1), compiled=compiled, scopes=compiled).collect()
        assert len(one) == 1 and any(x.startswith("file:a/main.py") for x in one[0].repository_knowledge) and set(one[0].repository_knowledge) <= set(one[0].current_truth)


def test_fallback_and_unified_reports(spark, tmp_path):
    engine = Engine(Store(spark, str(tmp_path / "f")))
    m = spark.createDataFrame([(i, "s", "fact", f"t{i}", T0 + timedelta(days=i)) for i in range(5)], "memory_id int, session_id string, memory_type string, title string, created_at timestamp")
    links = spark.createDataFrame([("memory:4", "memory:3", "related_to", 0.5), ("memory:4", "memory:0", "related_to", 0.9)], "source string, target string, relation string, weight double")
    nodes, edges = engine.dashboard_graph("session", m, links, 2)
    assert {r.id for r in nodes.collect()} == {"memory:3", "memory:4"} and [(r.source, r.target) for r in edges.collect()] == [("memory:4", "memory:3")]
    assert engine.unified_report() == "No cross-layer data available."
    n = spark.createDataFrame([("file:a.py", "a.py", "file"), ("d", "Use tables", "decision")], "id string, label string, node_type string")
    e = spark.createDataFrame([("session:1", "file:a.py", "modifies"), ("file:a.py", "session:1", "touched_by")], "source string, target string, relation string")
    said = report.unified_report(None, (n, e))
    assert "- `a.py` (2 sessions)" in said and "### Active Decisions (1)" in said and "Open Tasks" not in said


def test_search_and_vectors(spark, sf, tmp_path):
    engine = Engine(Store(spark, str(tmp_path / "v")))
    m = memories(spark, sf).drop("lexical_score", "semantic_score")
    hits = engine.search(m, Request(query="the or der", now=datetime(2026, 1, 1)), 5).collect()
    assert 0 < len(hits) <= 5
    with pytest.raises(RequestError):
        engine.memory_get(m, [])
    items = spark.createDataFrame([("a", "fact", [1.0, 0.0], False), ("b", "bug", [0.0, 1.0], False)], "id string, memory_type string, embedding array<float>, deleted boolean")
    engine.store.upsert_vectors(items, 1, "p1")
    engine.store.upsert_vectors(items.where("id = 'a'").selectExpr("id", "memory_type", "embedding", "true as deleted"), 2, "p1")
    assert [r.id for r in engine.store.search_vectors([1.0, 0.1], 3).collect()] == ["b"]
    assert [r.id for r in engine.store.search_vectors([0.0, 1.0], 3, ["bug"], "p1").collect()] == ["b"]
    before = sorted(map(str, engine.store.vectors().collect()))
    engine.store.compact_vectors(2)
    assert sorted(map(str, engine.store.vectors().collect())) == before
    engine.store.upsert_vectors(items.where("id = 'a'"), 3, "p1")
    assert {r.id for r in engine.store.get_vector("a").collect()} == {"a"} and engine.store.get_vector("b").count() == 1
    with pytest.raises(ValueError):
        engine.store.search_vectors([1.0, 0.0, 0.0], 3)


def test_id_maps(spark):
    u = [f"{i:08d}-0000-0000-0000-000000000000" for i in range(5)]
    forward = spark.createDataFrame([(u[0], 1), (u[1], 2), (u[2], 3), ("odd", 9)], "uuid string, number int")
    backward = spark.createDataFrame([(1, u[0]), (2, u[4]), (7, u[3]), (9, "odd")], "number int, uuid string")
    records = spark.createDataFrame([(u[0], u[0]), (u[1], u[2])], "key string, id string")
    got = {(r.fault, r.id) for r in id_map_faults(forward, backward, records).collect()}
    assert got == {("not a uuid", "odd"), ("no reverse mapping", u[2]), ("maps to another uuid", u[1]), ("no forward mapping", u[3]), ("no forward mapping", u[4]), ("record key", u[1])}
    f, b, n = normalised_maps(forward.limit(0), backward.limit(0), spark.createDataFrame([(4, u[0]), (6, u[0]), (5, u[1])], "number int, uuid string"))
    assert {(r.uuid, r.number) for r in f.collect()} == {(u[0], 4), (u[1], 5)} and b.count() == 3 and n == 7


def test_map_of_communities_is_kept(spark, tmp_path):
    """A second request reads the kept map alone; a moved head or a time gone by makes a new one."""
    engine = Engine(Store(spark, str(tmp_path / "maps")))
    assert engine.memory_communities(T0) is None
    uid = lambda i: f"memory:{i:08}-0000-0000-0000-000000000000"
    edges = spark.createDataFrame([(uid(i), uid(i + 1), "r", "extracted", 1.0) for i in (0, 1, 3)], "source string, target string, relation string, evidence string, weight double")
    nodes = spark.createDataFrame([(uid(i), "n", "memory") for i in range(5)] + [("file:x", "n", "file")], "id string, label string, node_type string")
    engine.build_graph("session", "one", nodes, edges, T0)
    first = {r.memory_id: r.community for r in engine.memory_communities(T0).collect()}
    assert len(first) == 5 and len(set(first.values())) == 2
    again = engine.memory_communities(T0 + timedelta(seconds=200))
    plan = "".join(str(f) for f in again.inputFiles())
    assert "community_maps" in plan and "graph_" not in plan and {r.memory_id: r.community for r in again.collect()} == first
    heads = lambda: engine.store.read("community_map_heads").count()
    assert heads() == 1
    engine.memory_communities(T0 + timedelta(seconds=301))
    assert heads() == 2
    engine.build_graph("session", "two", nodes.limit(2), edges.limit(1), T0 + timedelta(seconds=302))
    assert engine.memory_communities(T0 + timedelta(seconds=303)).count() == 2 and heads() == 3


def test_projects(spark, tmp_path):
    engine = Engine(Store(spark, str(tmp_path / "projects")))
    one = engine.project_resolve("  web  ")
    assert one["created"] and one["name"] == "web" and engine.project_resolve("web") == {**one, "created": False}
    assert engine.project_resolve("other", one["project_id"]) == {**one, "created": False}
    own = "12345678-1234-1234-1234-123456789abc"
    assert engine.project_resolve(None, own) == {"project_id": own, "name": "unnamed-project", "created": True}
    assert engine.store.read("projects").where(f"id = '{own}'").first().slug == "project-123456781234"
    engine.store.append("projects", spark.createDataFrame([("g", "everything", "global", 9)], "id string, name string, slug string, nth long"))
    assert engine.project_resolve("everything")["created"]
    with pytest.raises(ValueError):
        engine.project_resolve("x", "no id")
