"""Rules over single requests, by their cases: they read no table, so they are no queries."""

import pytest
from pyspark.sql import functions as F

from loomspan.functions import catalogue, text
from loomspan.operators import retrieval, traverse
from loomspan.plans.search import type_scopes, wants_detail
from loomspan.scope import Scope, ScopeError
from loomspan.sources import repository, sessions
from loomspan.tools import definitions


def test_sync_rules(spark):
    got = {(r.rule, r.name, r.kind) for r in repository.sync_rules(spark).where(F.col("name").isin("py", "docx", "node_modules")).collect()}
    assert got == {("extension", "py", "code"), ("extension", "docx", "office_document"), ("ignored_dir", "node_modules", None)}


@pytest.mark.parametrize(("query", "path", "name"), [("src/main.rs", True, False), ("main", False, True), ("two words", False, False), ("a\\b", True, False), ("x.y", True, True), ("ns::name", False, True), ("café", False, False)])
def test_query_kinds(query, path, name):
    assert (traverse.looks_like_path(query), traverse.looks_like_identifier(query)) == (path, name)


@pytest.mark.parametrize(("query", "parsed"), [("tables or rows", "tabl|row"), ('"store the tables" -old', "store@1+tabl@3&!old"), ("the and", ""), ("a -b or c d", "!b|c&d")])
def test_web_queries(query, parsed):
    one = lambda minus, placed: ("!" if minus else "") + ("+".join(f"{t}@{n}" for n, t in placed) if len(placed) > 1 else placed[0][1])
    assert "|".join("&".join(one(*c) for c in a) for a in retrieval.parse_query(query)) == parsed


def test_scope_suffixes():
    got = {p: retrieval.scope_suffix(namespace=p) for p in ("p1", "A b/", " ", "UP")}
    assert got["p1"] == "namespace_p1" and got["UP"] == "namespace_up" and got["A b/"].startswith("namespace_a_b_") and got[" "].startswith("namespace_value_")
    assert len(got["A b/"]) == len("namespace_a_b_") + 8


INTENTS = [
    ("", "hybrid"), ("which function", "repository_only"), ("what happened in prior sessions", "memory_only"), ("debugging history", "session_graph_only"), ("last session", "memory_only"),
    ("continue in the file", "hybrid"), ("rephrase this", "none"), ("summarize the module", "repository_only"), ("anything else", "hybrid"),
]


@pytest.mark.parametrize(("query", "intent"), INTENTS)
def test_intents(query, intent):
    assert retrieval.intent_of(query) == intent


@pytest.mark.parametrize(("query", "asks"), [("where did we leave it", False), ("parquet tables", False), ("Continue the work", True), ("what is next", True), ("prior work", True), ("open loops", True)])
def test_continuations(query, asks):
    assert retrieval.is_continuation(query) is asks


@pytest.mark.parametrize(("objective", "scopes", "hits"), [("anything", 6, 12), ("decide on the rule", 8, 20), ("continue the unfinished task", 12, 33), ("verified result", 7, 16)])
def test_type_scopes(objective, scopes, hits):
    found = type_scopes(objective)
    assert (len(found), sum(n for _, n in found)) == (scopes, hits)


@pytest.mark.parametrize(("objective", "detail"), [("how does it work", True), ("the patch", True), ("what is open", False)])
def test_context_words(objective, detail):
    assert wants_detail(objective) is detail


RECORDS = [
    ("response_item", "message", "user", "{}", "prompt"), ("response_item", "message", "assistant", "{}", "response"), ("response_item", "message", "developer", "{}", "annotation"),
    ("response_item", "function_call", None, "{}", "tool_call"), ("response_item", "custom_tool_call_output", None, "{}", "tool_result"), ("response_item", "reasoning", None, "{}", "reasoning"),
    ("response_item", "odd", None, "{}", None), ("event_msg", "agent_message", None, "{}", "agent_message"), ("event_msg", "token_count", None, "{}", None), ("event_msg", "x", None, '{"a":"it FAILED"}', "error"),
    ("event_msg", "x", None, '{"a":"a test"}', "test_result"), ("event_msg", "x", None, '{"a":"b"}', "annotation"), ("turn_context", None, None, "{}", "turn_context"),
]


def test_record_types(spark):
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(RECORDS)], "i int, top string, kind string, role string, payload string, want string")
    got = rows.withColumn("event_type", sessions.record_type(F.col("top"), F.col("kind"), F.col("role"), F.col("payload"))).collect()
    assert all(r.event_type == r.want for r in got) and len(got) == len(RECORDS)


def test_tool_names():
    names = "session_start session_event_append session_end repository_sync health_check mem_search context_build context_compile_v2 graph_snapshot knowledge_graph_export knowledge_report knowledge_query knowledge_communities memory_get_batch memory_get claim_govern"
    assert [d["name"] for d in definitions()] == names.split()


@pytest.mark.parametrize(("bound", "asked", "result"), [(None, "p1", "p1"), ("p1", "p1", "p1"), ("p1", None, "p1"), ("p1", "p2", None)])
def test_scope_override(bound, asked, result):
    if result is None:
        with pytest.raises(ScopeError):
            Scope("o", "t", bound).override(asked)
    else:
        assert Scope("o", "t", bound).override(asked).project_id == result


def test_sql_functions(spark):
    """They give what the column functions give, see the session's scope, and are pushed down."""
    names = catalogue.register(spark)
    rows = spark.createDataFrame([(1, "Fix THE parser's 2nd Error in src/main.rs"), (2, ""), (3, None), (4, "deadbeef01  failed:\n\t at 0x12")], "id int, x string")
    rows.createOrReplaceTempView("texts")
    got = spark.sql("SELECT id, canonical_text(x) a, claim_text(x) b, stable_id(x) c, error_signature(x) d, claim_key('bug', 'parser', x) e FROM texts")
    want = rows.select("id", text.canonical(F.col("x")).alias("a"), text.claim_text(F.col("x")).alias("b"), text.stable_id(F.col("x")).alias("c"), text.error_signature(F.col("x")).alias("d"), F.concat_ws(":", F.lit("bug"), F.lit("parser"), text.claim_text(F.col("x"))).alias("e"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    goals = {r.id: r.g for r in rows.select("id", F.coalesce(text.sub_goals(F.col("x")), F.array().cast("array<string>")).alias("g")).collect()}
    found: dict = {}
    for r in spark.sql("SELECT id, position, goal FROM texts, LATERAL goals_in(x) ORDER BY id, position").collect():
        found.setdefault(r.id, []).append(r.goal)
    assert found == {i: g for i, g in goals.items() if g}
    catalogue.bind(spark, organization_id="o", team_id="t", team_role="admin")
    scope = "SELECT o, t, p FROM VALUES ('o', 't', 'p'), ('o', 't', NULL), ('o', 'u', 'p'), ('q', 't', 'p'), ('o', 't', 'r') AS v(o, t, p) WHERE app_is_scoped_to_row(o, t, p)"
    assert spark.sql(scope).count() == 3 and spark.sql("SELECT app_is_team_admin()").first()[0]
    catalogue.bind(spark, organization_id="o", team_id="t", project_id="r")
    assert {r.p for r in spark.sql(scope).collect()} == {None, "r"} and not spark.sql("SELECT app_is_team_admin()").first()[0]
    catalogue.bind(spark)
    assert spark.sql(scope).count() == 0 and len(names) == len(catalogue.FUNCTIONS)
    with pytest.raises(ValueError):
        catalogue.bind(spark, tenant="x")
