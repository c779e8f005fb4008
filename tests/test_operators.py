"""Small fixtures of operators that SQL does not check."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import text
from loomspan.operators import claims, cluster, context, events, graph, ranking, reconcile, relational, retrieval, traverse
from loomspan.scope import Scope, ScopeError, scoped, with_global_fallback

T0 = datetime(2025, 1, 1)


def session(spark, rows, session_id="s"):
    """rows: (minutes, type, message)."""
    data = [(session_id, f"e{i}", i, k, m, None, None, None, None, T0 + timedelta(minutes=t)) for i, (t, k, m) in enumerate(rows)]
    return spark.createDataFrame(data, "session_id string, event_id string, ordinal long, event_type string, message string, command string, tool_name string, file_path string, exit_code int, created_at timestamp")


def test_episodes_break_on_class_gap_and_cap(spark):
    rows = [(i, "prompt", "hello there") for i in range(9)] + [(9, "error", "it failed"), (10, "error", "again"), (26, "error", "later")]
    got = [r.episode for r in events.episodes_of(session(spark, rows)).orderBy("ordinal").collect()]
    assert got == [1] * 8 + [2] + [3, 3] + [4]


def test_claims_of_events(spark):
    rows = [(0, "prompt", "Decision: we use parquet for all tables"), (1, "reasoning", "Decision: never stored at all"), (2, "response", "We must not delete this table"), (3, "error", "build failed with code 3"), (4, "prompt", "Is this open? maybe a hypothesis?")]
    got = {r.segment: r for r in claims.atomic_claims(session(spark, rows)).collect()}
    assert "Decision: never stored at all" not in got
    d = got["Decision: we use parquet for all tables"]
    assert (d.claim_type, d.authority, d.verification, d.admitted, d.title) == ("decision", "user_confirmed", "user_confirmed", True, "Decision: we use parquet for all tables")
    assert d.claim_key == "decision:global:use_parquet_for_all_tables"
    c = got["We must not delete this table"]
    assert (c.claim_type, c.polarity, c.admitted) == ("constraint", "negative", False)
    assert got["build failed with code 3"].claim_type == "bug" and got["build failed with code 3"].admitted
    q = got["Is this open? maybe a hypothesis?"]
    assert q.claim_type == "open_question" and q.verification == "unverified" and not q.admitted


def test_quiet_sessions_fall_back(spark):
    e = session(spark, [(0, "prompt", "plain words only here"), (20, "prompt", "and some more of them")])
    ep = events.materialise_episodes(events.episodes_of(e))
    kinds = sorted(r.title for r in claims.session_memories(events.episodes_of(e), ep).collect())
    assert "Session summary" in kinds and "Session reflection summary" in kinds and len(kinds) == 4


def test_reconcile_in_order_sees_changes(spark):
    def row(i, kind, pol, auth, ver):
        return (f"c{i}", "p", "k", "s", kind, pol, auth, ver, True, T0 + timedelta(days=i), T0)

    rows = [row(1, "bug", "positive", "test_verified", "verified"), row(2, "fix", "negative", "repository", "verified"), row(3, "fact", "positive", "session_derived", "inferred")]
    df = spark.createDataFrame(rows, "claim_id string, project_id string, claim_key string, subject string, claim_type string, polarity string, authority string, verification string, admitted boolean, valid_from timestamp, created_at timestamp")
    got = sorted(tuple(r) for r in reconcile.reconcile_in_order(df).collect())
    assert got == [("c2", "c1", "contradicts", 0.86), ("c2", "c1", "supersedes", 0.9), ("c3", "c1", "confirms", 0.62), ("c3", "c2", "contradicts", 0.86)]
    full = df.withColumn("superseded_by", F.lit(None).cast("string"))
    after = {r.claim_id: r for r in reconcile.apply_edges(full, reconcile.reconcile_edges(reconcile.prior_candidates(df, df))).collect()}
    assert after["c1"].superseded_by == "c2" and after["c1"].verification == "contradicted"


def test_edge_metadata_fold(spark):
    rows = [("a", "b", "r", "inferred", 0.5, {"x": "1"}, 1), ("a", "b", "r", "inferred", 0.4, {"y": "2"}, 2), ("a", "b", "r", "extracted", 0.3, {"x": "3", "z": "4"}, 3), ("a", "b", "r", "inferred", 0.9, {"w": "5"}, 4)]
    df = spark.createDataFrame(rows, "source string, target string, relation string, evidence string, weight double, metadata map<string,string>, position int")
    r = graph.merge_edges_with_metadata(df).first()
    assert (r.evidence, r.weight, r.metadata) == ("extracted", 0.9, {"x": "3", "z": "4", "w": "5"})


@pytest.mark.parametrize("method", ["greedy", "leiden"])
def test_communities_split_two_cliques(spark, method):
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(6) for j in range(i)] + [("a0", "b0")]
    edges = spark.createDataFrame([(a, b, "r", "extracted", 1.0) for a, b in pairs], "source string, target string, relation string, evidence string, weight double")
    nodes = spark.createDataFrame([(f"{g}{i}", "n", "file") for g in "ab" for i in range(6)] + [("lone", "n", "file")], "id string, label string, node_type string")
    got = {r.id: r.community for r in cluster.communities(nodes, edges, method).collect()}
    assert len(got) == 13 and got["lone"] not in (got["a1"], got["b1"])
    if method == "leiden":
        assert len({got[f"a{i}"] for i in range(6)}) == 1 and got["a1"] != got["b1"]
    label = {r.id: r.label for r in cluster.propagate(nodes, graph.both_ways(edges, "weight")).collect()}
    assert len(label) == 13


def test_leiden_beats_singletons():
    a = np.array([0, 1, 2, 3, 4, 5, 0, 3, 1, 4, 2, 5, 2, 3])
    b = np.array([1, 0, 3, 2, 5, 4, 2, 5, 2, 3, 1, 3, 0, 4])
    found = cluster.modularity_labels(6, a, b, np.ones(len(a)))
    assert len(found) == 6 and len(set(found.tolist())) < 6


def test_paths(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "y"), ("c", "d", "z"), ("a", "e", "w"), ("e", "d", "v")], "source string, target string, relation string")
    path = traverse.shortest_path(edges, "a", "d")
    assert [r.id for r in path.orderBy("pos").collect()] == ["a", "e", "d"]
    assert [r.relation for r in traverse.path_edges(edges, path).orderBy("pos").collect()] == ["w", "v"]
    assert traverse.shortest_path(edges, "a", "nowhere").collect() == []
    nodes = spark.createDataFrame([(c, f"node {c}") for c in "abcde"], "id string, label string")
    best = traverse.goal_search(nodes, edges, "node xyz", "a", 2)
    assert not best.isEmpty()
    assert traverse.goal_search(nodes, edges, "the and", "a").collect() == []


def test_similarity_edges_are_capped(spark):
    words = "alpha1 bravo2 charlie3 delta4 echo5 foxtrot6"
    m = spark.createDataFrame([(str(i), None, None, "fact", words, f"{words} {i}xyz", "p") for i in range(5)], "memory_id string, session_id string, episode long, memory_type string, title string, content string, project_id string")
    got = graph.similarity_edges(m, ["project_id"]).collect()
    ends = [x for r in got for x in (r.source, r.target)]
    assert got and max(ends.count(e) for e in set(ends)) <= 2


def test_text_search(spark):
    docs = spark.createDataFrame([(1, "Parquet tables", "", "we store tables"), (2, "", "", "storing the tables in rows"), (3, "rows", "", "nothing")], "id long, title string, summary string, content string")
    ids = lambda q: [r.id for r in retrieval.match(docs, q).orderBy(F.desc("rank"), "id").collect()]
    assert ids("table") == [1, 2] and ids("tables -rows") == [1] and ids("parquet or rows") == [1, 3, 2] and ids('"store tables"') == [1] and ids("") == []
    assert retrieval.index(docs).where("term = 'tabl'").count() == 3


def test_embeddings(spark):
    df = spark.createDataFrame([("x", "abc abc def"), ("y", "")], "id string, t string")
    e = retrieval.hash_embedding(df, "id", "t", 64)
    assert abs(e.groupBy("id").agg(F.sum(F.col("value") ** 2).alias("n")).first()["n"] - 1) < 1e-9
    d = retrieval.dense(e, "id", 64).first()
    assert len(d.embedding) == 64
    assert spark.range(1).select(text.fnv1a(F.lit("abc"))).first()[0] == 440920331
    assert [r.similarity for r in retrieval.nearest(retrieval.dense(e, "id", 64), list(d.embedding), 1).collect()] == [1.0]


def test_pack_and_cover(spark):
    rows = [("r", f"i{i}", "memory", k, None, "verified", "repository", t, None, None, 2) for i, (k, t) in enumerate([("decision", 50), ("task", 60), ("fact", 10), ("fact", 500), ("decision", 5)])]
    items = spark.createDataFrame(rows, "request_id string, item_id string, source_class string, memory_type string, claim_key string, verification string, authority string, tokens int, valid_to string, superseded_by string, proofs int")
    packed = context.pack(items, 130).collect()
    assert sum(r.tokens for r in packed) <= 130 and {r.item_id for r in packed} == {"i0", "i1", "i2", "i4"}
    chosen = context.compile_cover(items.withColumn("goals", context.goals_of(F.lit("x"))), 80)
    assert [(r.item_id, r.stage) for r in chosen.orderBy("place").collect()] == [("i4", "proof"), ("i2", "proof"), ("i1", "proof")]
    gaps = context.proof_gaps(items.select("request_id", context.goals_of(F.lit("a bug")).alias("goals")).distinct(), chosen)
    assert gaps.first().gaps == ["bugs", "fixes"]
    said = context.advice(items, "repository_only").first()
    assert len(said.unknowns) == 1 and len(said.recommended) == 1


def test_scope(spark):
    df = spark.createDataFrame([("o", "t", "p"), ("o", "t", "q"), ("o", "x", "p")], "organization_id string, team_id string, project_id string")
    assert scoped(df, Scope("o", "t")).count() == 2 and scoped(df, Scope("o", "t", "p")).count() == 1
    with pytest.raises(ScopeError):
        Scope("o", "t", "p").override("q")
    assert with_global_fallback(df.limit(0), df).count() == 3 and with_global_fallback(df.where("project_id = 'q'"), df).count() == 1


def test_relational(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, n int")
    assert sorted(tuple(r) for r in relational.latest(df, ["k"], ["n"]).collect()) == [(1, "b", 2), (2, "c", 1)]
    assert relational.insert_or_ignore(df, df.withColumn("k", F.col("k") + 1), ["k"]).count() == 4
    once = relational.set_once(df.withColumn("v", F.when(F.col("k") == 2, F.col("v"))), spark.createDataFrame([(1, "z"), (2, "y")], "k int, v string"), "k", "v")
    assert sorted(str(r.v) for r in once.collect()) == ["c", "z", "z"]
    m = spark.range(1).select(relational.merge_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))).alias("m")).first().m
    assert m == {"a": 1, "b": 3}


def test_governance_and_as_of(spark):
    c = spark.createDataFrame([("c", "active", T0, None), ("d", "active", T0, T0 + timedelta(days=1))], "claim_id string, governance string, valid_from timestamp, valid_to timestamp")
    d = spark.createDataFrame([("c", "pinned", T0), ("c", "rejected", T0 + timedelta(days=1))], "claim_id string, state string, decided_at timestamp")
    after, history = claims.govern(c, d)
    assert {r.claim_id: r.governance for r in after.collect()} == {"c": "rejected", "d": "active"}
    assert [(r.previous_state, r.state) for r in history.orderBy("decided_at").collect()] == [("active", "pinned"), ("pinned", "rejected")]
    assert [r.claim_id for r in claims.claims_as_of(c, F.lit(T0 + timedelta(days=2))).collect()] == ["c"]


def test_query_cues():
    assert [retrieval.intent_of(q) for q in ("", "which function", "past sessions", "last session", "continue in the file", "rephrase it")] == ["hybrid", "repository_only", "session_graph_only", "memory_only", "hybrid", "none"]
    assert retrieval.intent_of("rephrase it", True) == "repository_only"
    assert retrieval.is_continuation("Where we left off?") and not retrieval.is_continuation("parquet")
    assert ranking.Request().intent == "hybrid"


def test_items_and_bags(spark):
    nodes = spark.createDataFrame([("file:a/b.py", "b.py", "file", "repository", "a/b.py", "a/b.py"), ("symbol:x", "x", "symbol", "repository", "a/b.py", "a/b.py")], "id string, label string, node_type string, source_type string, source_id string, source_file string")
    got = {r.item_id: r.summary for r in context.repository_items(nodes, "x", ("a/b.py",)).collect()}
    assert got["file:a/b.py"] == "b.py; type file; in a/b.py; from repository" and "symbol:x" in got
    a, b = spark.createDataFrame([(1, "a b a"), (2, "c")], "id int, t string"), spark.createDataFrame([(1, "a b"), (3, "d")], "id int, t string")
    out = {r.id: (r.cosine, r.overlap) for r in retrieval.bag_cosine(a, b, "id", "t").collect()}
    assert out == {1: (0.948683, 2), 2: (0.0, 0), 3: (0.0, 0)}
    hits = spark.createDataFrame([(1, 0, "verified"), (2, 2, "verified"), (3, None, "contradicted")], "id int, conflicts int, verification string")
    assert [df.count() for df in context.conflict_split(hits)] == [1, 2]
