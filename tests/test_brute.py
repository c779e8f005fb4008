"""Operators that depend on order, against plain versions."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import cluster, context, graph, proofs, ranking, reconcile, relational, retrieval, traverse

ITEM = "request_id string, item_id string, source_class string, memory_type string, claim_key string, title string, verification string, authority string, tokens int, valid_to string, superseded_by string, proofs int, goals array<string>"


def plain_cover(items, budget):
    """Greedy cover and filler of one request, item by item."""
    factor = {"repository": 1.0, "user_confirmed": 1.0, "tool_verified": 0.95, "test_verified": 0.95, "session_derived": 0.55, "model_derived": 0.0, None: 0.5}
    share = {"repository": 0.8, "memory": 0.6, "session_graph": 0.5, "conflict": 0.7}
    able = [x for x in items if x["source_class"] != "memory" or (x["authority"] != "model_derived" and x["verification"] not in ("contradicted", "unverified") and not x["superseded_by"])]
    fresh = lambda x: 0.35 if x["valid_to"] else 1.0
    long_, short = (lambda x: x["claim_key"] or (x["source_class"], x["title"].strip().lower())), (lambda x: x["claim_key"] or (x["source_class"], x["title"]))
    seen, few = set(), []
    for x in able:
        if long_(x) not in seen:
            seen.add(long_(x))
            few.append(x)
    open_, used, keys, out = set(items[0]["goals"]), 0, set(), []
    goal = lambda x: context.GOAL_OF_TYPE.get(x["memory_type"]) if x["source_class"] == "memory" else None
    while open_:
        best, top = None, -1.0
        for x in few:
            if short(x) in keys or goal(x) not in open_ or not x["tokens"]:
                continue
            score = fresh(x) * factor[x["authority"]] * max(0.25, min(1.0, x["proofs"] / 2)) / x["tokens"]
            if score > top:
                best, top = x, score
        if best is None or used + best["tokens"] > budget:
            break
        used += best["tokens"]
        open_.discard(goal(best))
        keys.add(short(best))
        out.append((best["item_id"], "proof"))
    for x in sorted([x for x in able if short(x) not in keys], key=lambda x: -(share[x["source_class"]] * factor[x["authority"]] * fresh(x))):
        if used + x["tokens"] <= budget:
            used += x["tokens"]
            out.append((x["item_id"], "filler"))
    return out


def test_cover_against_plain(spark):
    rng = random.Random(8)
    names = [c.split()[0] for c in ITEM.split(", ")]
    rows, want = [], {}
    for r in range(30):
        own = []
        for i in range(rng.randrange(1, 60)):
            kind = rng.choice([*context.GOAL_OF_TYPE, "summary", "risk"])
            own.append((f"r{r}", f"i{i:03}", rng.choice(["memory"] * 4 + ["repository", "session_graph", "conflict"]), kind, rng.choice([None, f"k{rng.randrange(12)}"]), f"title {rng.randrange(9)}",
                        rng.choice(["verified", "inferred", "contradicted", "unverified", None]), rng.choice(["repository", "session_derived", "model_derived", "tool_verified", None]), rng.choice([0, 1, 5, 9, 20, 40, 90]),
                        rng.choice([None, None, "2024"]), rng.choice([None, None, "x"]), rng.randrange(4), ["decisions", "active_tasks", "facts", "bugs"]))
        rows += own
        want[f"r{r}"] = plain_cover([dict(zip(names, x, strict=True)) for x in own], 120)
    got: dict = {k: [] for k in want}
    for x in context.compile_cover(spark.createDataFrame(rows, ITEM).repartition(5), 120).orderBy("request_id", "place").collect():
        got[x.request_id].append((x.item_id, x.stage))
    for k, v in want.items():
        assert sorted(got[k]) == sorted(v) and [x for x in got[k] if x[1] == "proof"] == [x for x in v if x[1] == "proof"]


def test_cover_rules(spark):
    """Repository items pass whatever their authority, one item a claim key, what does not fit ends the cover, a hot request is not cut."""
    row = lambda i, source, kind, key, ver, auth, n: ("r", i, source, kind, key, i, ver, auth, n, None, None, 2, ["decisions", "facts"])
    rows = [row("a", "repository", "fact", None, "unverified", "model_derived", 5), row("b", "memory", "fact", "k", "verified", "repository", 10), row("c", "memory", "fact", "k", "verified", "repository", 2), row("d", "memory", "decision", None, "contradicted", "repository", 1)]
    got = [(x.item_id, x.stage) for x in context.compile_cover(spark.createDataFrame(rows, ITEM), 100).orderBy("place").collect()]
    assert got == [("b", "proof"), ("a", "filler")]
    assert context.compile_cover(spark.createDataFrame(rows[1:2], ITEM), 9).collect() == []
    many = [row(f"m{i:05}", "repository", "fact", None, "verified", "repository", 1) for i in range(3000)]
    assert context.compile_cover(spark.createDataFrame(many, ITEM), 2500).count() == 2500
    assert context.compile_cover(spark.createDataFrame([], ITEM), 10).collect() == []


def test_matching_against_going_through_all(spark):
    rng = random.Random(4)
    pairs = list({(min(a, b), max(a, b)): None for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(300)) if a != b})
    rows = [(a, b, rng.choice([0.5, 0.6, 0.7, 0.8])) for a, b in pairs]
    taken: dict = {}
    want = set()
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if taken.get(a, 0) < 2 and taken.get(b, 0) < 2:
            taken[a], taken[b] = taken.get(a, 0) + 1, taken.get(b, 0) + 1
            want.add((a, b, s))
    got = graph.matched(spark.createDataFrame(rows, "left int, right int, similarity double"), 2)
    assert {tuple(r) for r in got.collect()} == want
    assert graph.matched(spark.createDataFrame([], "left int, right int, similarity double")).collect() == []


def test_proofs_of_a_large_pack_are_the_last_of_each_key(spark):
    """6,000 items a request, whose proofs were compared in time that grows with their square; a null request, and one without proofs."""
    from loomspan.operators import context

    kind = "array<struct<source_ref:string,session_id:string,session_event_id:string,proof_type:string,excerpt:string>>"
    i = F.col("id")
    proof = F.struct(F.concat(F.lit("r"), i % 7).alias("source_ref"), F.when(i % 3 > 0, "s").alias("session_id"), (i % 2).cast("string").alias("session_event_id"), F.lit("p").alias("proof_type"), i.cast("string").alias("excerpt"))
    request = F.when(i % 2 == 0, "a").when(i < 11_990, "b").when(i < 11_998, "c")
    items = spark.range(12_000).select(request.alias("request_id"), i.alias("item_id"), F.lit("memory").alias("source_class"), F.lit("fact").alias("memory_type"), F.lit("verified").alias("verification"), F.lit(None).cast("string").alias("authority"), F.when(i % 2 == 0, F.array(proof, proof)).when(i < 11_990, F.array(proof)).cast(kind).alias("proof_handles"))
    chosen = items.select("request_id", "item_id", (-F.col("item_id")).alias("place"))
    got = {r.request_id: r for r in context.context_pack(items, chosen).collect()}
    for name, first in (("a", 0), ("b", 1)):
        want: dict = {}
        for k in range(first, 11_990 if name == "b" else 12_000, 2):
            want.setdefault((f"r{k % 7}", "s" if k % 3 else None, str(k % 2)), str(k))
        assert {(x.source_ref, x.session_id, x.session_event_id): x.excerpt for x in got[name].proof_handles} == want
        assert [x.source_ref for x in got[name].proof_handles] == sorted(x.source_ref for x in got[name].proof_handles) and len(got[name].proof_handles) == len(want)
    assert got["c"].proof_handles == [] and len(got["c"].project_facts) == 4 and set(got) == {"a", "b", "c"}


def test_mentions_are_containment(spark):
    names = ["a/b/main.py", "lib/my file.rs", "x.c", "q", "über/straße.md", "deep/dir/", "main.py"]
    texts = {1: ("see main.pyc", "xmain.py!"), 2: ("my file.rs", None), 3: (None, "ax.cb"), 4: ("", "Quiet"), 5: ("straße.md", "q"), 6: (None, None)}
    m = spark.createDataFrame([(k, t, c) for k, (t, c) in texts.items()], "memory_id int, title string, content string")
    f = spark.createDataFrame([(n,) for n in names] + [(None,), ("  ",)], "path string")
    want = {(f"memory:{k}", f"file:{n}") for k, (t, c) in texts.items() for n in names if n.rsplit("/", 1)[-1] and n.rsplit("/", 1)[-1] in f"{t or ''} {c or ''}"}
    assert {(r.source, r.target) for r in graph.mention_edges(m, f).collect()} == want and len(want) == 6
    both = graph.mention_edges(m.withColumn("session_id", F.lit("s")), f.withColumn("session_id", F.lit("t")), ("session_id",))
    assert both.collect() == []


def test_similar_pairs_count_few_sets(spark, monkeypatch):
    """Sets that share rare tokens and little else are left out by their parity bits; pairs are those of all against all, in each block."""
    rng = random.Random(8)
    rows = []
    for k in range(60):
        own = {f"w{rng.randrange(4000)}" for _ in range(60)} | {f"rare{k % 3}{i}" for i in range(3)}
        rows += [(2 * k, "p", sorted(own)), (2 * k + 1, "p" if k % 4 else "q", sorted(set(sorted(own)[k % 30 :]) | {f"x{k}{i}" for i in range(k % 5)}))]
    rows.append((0, "q", ["a", "b", "c", "d"]))
    want = {(g, i, j) for i, g, x in rows for j, h, y in rows if g == h and i < j and len(set(x) & set(y)) >= 4 and 2 * len(set(x) & set(y)) >= len(set(x) | set(y))}
    got = graph.similar_pairs(spark.createDataFrame(rows, "id int, g string, w array<string>"), "id", "w", ["g"])
    assert {(r.g, r.left, r.right) for r in got.collect()} == want and len(want) > 30
    assert "bit_count" in got._jdf.queryExecution().toString()


def _all_pairs(rows, least=0.5):
    """What the SQL's self-join gives: each two rows of a block, once for each row."""
    keys = [(g, i, set(x or [])) for i, g, x in rows if g is not None and i is not None]
    return sorted((g, i, j, len(x & y)) for g, i, x in keys for h, j, y in keys if g == h and i < j and len(x & y) >= 4 and len(x & y) / len(x | y) >= least)


def test_similar_pairs_of_repeated_ids(spark):
    """Rows that share an id, in a block or in two, are sets of their own; nulls and small sets meet nothing; whole-number bounds hold."""
    w = [f"w{k}" for k in range(40)]
    rows = [(1, "p", w[:10]), (1, "p", w[20:30]), (2, "p", w[:9]), (2, "p", w[20:29]), (2, "q", w[:8]), (1, "q", w[:8]), (3, "p", w[:10]), (None, "p", w[:10]), (4, None, w[:10]), (5, "p", None), (6, "p", []), (7, "q", w[:3]), (8, "q", w[:3])]
    df = spark.createDataFrame(rows, "id int, g string, w array<string>")
    got = graph.similar_pairs(df, "id", "w", ["g"]).collect()
    want = _all_pairs(rows)
    assert sorted((r.g, r.left, r.right, r.shared) for r in got) == want and len(want) == 5
    # 11 of 20 tokens are 0.55, though 0.55 * 20 is above 11 in floating point.
    close = [(1, "p", w[:20]), (2, "p", w[:11]), (3, "p", w[:10])]
    got = graph.similar_pairs(spark.createDataFrame(close, "id int, g string, w array<string>"), "id", "w", ["g"], least=0.55).collect()
    assert sorted((r.g, r.left, r.right, r.shared) for r in got) == _all_pairs(close, 0.55) == [("p", 1, 2, 11), ("p", 2, 3, 10)]


def test_tokens_are_lower_case_as_in_sql(spark):
    from loomspan.functions.text import similarity_tokens

    text = "\u0130STANBUL \u212aELVIN ABC\u0130DEF"
    assert spark.createDataFrame([(text,)], "t string").select(similarity_tokens(F.col("t"))).first()[0] == ["istanbul", "kelvin", "abcidef"]


def test_similar_pairs_of_blocks_in_parts(spark, monkeypatch):
    """A block taken apart, also where sets of one size are too many for a part, gives the pairs of all against all, each once; sets that met are no rows."""
    rng, rows = random.Random(5), []
    for k in range(50):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([6, 20, 20, 20, 45]))]
        rows += [(len(rows) + d, "p" if k % 5 else "q", sorted(set(base[d:]) | {f"y{k}{d}{i}" for i in range(rng.randrange(3))})) for d in range(rng.randrange(1, 7))]
    rows += [(1000 + k, "r", ["a", "b", "c", "d", "e"]) for k in range(12)] + [(3, "q", ["a", "b", "c", "d"])]
    df, want = spark.createDataFrame(rows, "id int, g string, w array<string>"), _all_pairs(rows)
    for part in (20, 150, 1 << 23):
        monkeypatch.setattr(graph, "PART", part)
        pairs = graph.similar_pairs(df, "id", "w", ["g"])
        assert sorted((r.g, r.left, r.right, r.shared) for r in pairs.collect()) == want and len(want) > 200
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan


def test_memory_similarity_joins_no_texts(spark, tmp_path, monkeypatch):
    """A memory for each label of a document, as the SQL has it, while the texts are not joined with the labels."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    words = [f"word{k}" for k in range(12)]
    docs = [(1, " ".join(words), "p"), (2, " ".join(words[:10]), "p"), (2, " ".join(words[1:]), "p"), (3, "Other Words " + " ".join(words[:9]), "p"), (4, " ".join(words), "q"), (5, None, "p"), (6, "\u0130ab \u0130cd \u0130ef \u0130gh", "q"), (7, "iab icd ief igh", "q")]
    labels = [(1, 1, 0), (2, 1, 0), (2, 0, 1), (3, 0, 0), (3, 0, 0), (3, 1, 1), (9, 1, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, own = [], graph.similar_pairs
    monkeypatch.setattr(graph, "similar_pairs", lambda df, *more: seen.append(df) or own(df, *more))
    got = sorted(map(tuple, queries()["C11_memory_similarity"](spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert got == sorted(db.execute(oracle_sql()["C11_memory_similarity"]).fetchall()) and len(got) > 8
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_names_meet_few_texts(spark, monkeypatch):
    """Names whose runs of three characters are in all texts meet only the texts that hold a run of eight of theirs."""
    stem = ["import", "portal", "talent", "lentil", "tilapi"]
    texts = [(i, f"{stem[i % 5]}.py and import portal talent lentil tilapi import-s .py long_{i:03}_name.rs" if i % 7 else None) for i in range(200)]
    names = [(f"{x}.py",) for x in stem] + [(f"long_{i:03}_name.rs",) for i in range(0, 300, 3)] + [("",), (None,), ("\U0001f600",), ("y",)]
    seen, own = [], graph._runs
    monkeypatch.setattr(graph, "_runs", lambda df, *more: seen.append(own(df, *more)) or seen[-1])
    got = graph.mentions(spark.createDataFrame([*texts, (200, "\U0001f600"), (201, "x.p")], "id int, t string"), spark.createDataFrame(names, "n string"), "id", "t", "n").collect()
    every = [*texts, (200, "\U0001f600")]
    want = sorted((i, n) for i, t in every for (n,) in names if t and n and n in t)
    assert sorted((r.id, r.n) for r in got) == want and len(want) > 300
    assert seen[1].where("id = 1").count() <= 14


def test_companions_of_large_episodes(spark):
    """All pairs of an episode, whose targets go together as arrays; none of other episodes or without one."""
    i = F.col("id")
    kind = F.when(i % 3 == 0, "summary").when(i % 3 == 1, "bug").otherwise(F.when(i % 2 == 0, "implementation_detail").otherwise("fact"))
    m = spark.range(600).select(i.alias("memory_id"), F.when(i > 9, (i % 2).cast("string")).alias("session_id"), F.when(i < 590, i % 5).alias("episode"), kind.alias("memory_type"))
    rows = m.where("session_id is not null and episode is not null").collect()
    want = sorted((f"memory:{a.memory_id}", f"memory:{b.memory_id}") for a in rows for b in rows if a.memory_type == "summary" and b.memory_type in ("bug", "implementation_detail") and (a.session_id, a.episode) == (b.session_id, b.episode))
    found = graph.companion_edges(m)
    assert sorted((r.source, r.target) for r in found.collect()) == want and len(want) > 1000
    assert "explode(_targets" in found._jdf.queryExecution().toString()


def test_continuity(spark):
    rows = [(f"s{i:02}", "p" if i % 2 else "q", i, ["a", "a", " ", "b"] if i % 3 else [" "]) for i in range(60)]
    got = graph.continuity_edges(spark.createDataFrame(rows, "session_id string, project_id string, ended_at int, files array<string>"), 3).collect()
    want = {(f"session:s{j:02}", f"session:s{i:02}", 2) for i in range(60) if i % 3 for j in range(i - 6, i, 2) if j >= 0}
    assert {(r.source, r.target, r.shared_files) for r in got} == want and len(got) == len(want)


def test_goal_search_against_plain(spark):
    rng = random.Random(6)
    words = ["worker", "oom", "bug", "cache", "queue", "noise"]
    label = {f"n{i}": f"{rng.choice(words)} {rng.choice(words)}" for i in range(14)}
    edges = sorted({(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}", rng.choice(["calls", "queue"])) for _ in range(40)})
    edges = [e for e in edges if e[0] != e[1]]
    goals = ["worker", "oom", "bug", "cache"]
    cover = lambda n: frozenset(g for g in goals if g in f"{n} {label[n]}")
    near: dict = {}
    for k, (a, b, r) in enumerate(edges):
        near.setdefault(a, []).append((b, k, r))
        near.setdefault(b, []).append((a, k, r))
    for start in ("n0", "n5", "n9"):
        seen, level, done, part = {("", cover(start))}, [(start, cover(start), (start,), ())], [], []
        seen = {(start, cover(start))}
        if len(cover(start)) == 4:
            done.append((0, 0))
        for _ in range(3):
            found: dict = {}
            for node, got, path, taken in level:
                if len(got) == 4:
                    continue
                for to, k, rel in near.get(node, []):
                    open_ = [g for g in goals if g not in got]
                    hits = sum(g in f"{label[node]} {node} {rel} {label[to]} {to}" for g in open_)
                    if k in taken or hits / len(open_) < 0.15:
                        continue
                    key = (to, got | cover(to))
                    if key not in seen:
                        found.setdefault(key, []).append((path + (to,), taken + (k,)))
            level = []
            for (to, got), ways in found.items():
                path, taken = min(ways)
                seen.add((to, got))
                level.append((to, got, path, taken))
                (done if len(got) == 4 else part).append((4 - len(got), len(path) - 1))
        want = sorted(done or part or [(4 - len(cover(start)), 0)])[:5]
        nodes = spark.createDataFrame(list(label.items()), "id string, label string")
        got = traverse.goal_search(nodes, spark.createDataFrame(edges, "source string, target string, relation string"), " ".join(goals), start, 3)
        assert sorted((r.uncovered, r.length) for r in got.collect()) == want


def test_many_goals(spark):
    nodes = spark.createDataFrame([("a", " ".join(f"goal{i:03}" for i in range(50))), ("b", " ".join(f"goal{i:03}" for i in range(50, 100)))], "id string, label string")
    edges = spark.createDataFrame([("a", "b", "r")], "source string, target string, relation string")
    got = traverse.goal_search(nodes, edges, " ".join(f"goal{i:03}" for i in range(100)), "a").collect()
    assert [(r.length, r.covered, r.complete) for r in got] == [(1, 100, True)]


def test_nearest_keeps_ties_by_key(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 4))
    rows = [(int(i), [float(v) for v in base[i % 6]]) for i in rng.permutation(90)]
    queries = [(q, [float(v) for v in rng.normal(size=4)]) for q in range(7)]
    got: dict = {}
    v, qs = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5), spark.createDataFrame([*queries, (99, None)], "query_id long, embedding array<double>")
    for r in retrieval.batch_nearest(v, qs, 4, block=3).collect():
        got.setdefault(r.query_id, []).append((-r.similarity, r.id))
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in rows}
    for q, x in queries:
        every = sorted((-max(0.0, round(float(unit[i] @ (np.array(x) / np.linalg.norm(x))), 9)), i) for i, _ in rows)
        assert [i for _, i in sorted(got[q])] == [i for _, i in every[:4]]
    assert 99 not in got


def test_sessions_of_both_sides(spark):
    lexical = spark.createDataFrame([(1, 0.5, ["s1", "s2"]), (2, 0.1, None)], "id int, score double, session_ids array<string>")
    semantic = spark.createDataFrame([(1, 0.2, ["s2", "s3"]), (1, 0.4, ["s4"]), (3, 0.0, ["s5"])], "id int, distance double, session_ids array<string>")
    got = {r.id: (r.session_ids, r.lexical_score, round(r.semantic_score or 0, 4)) for r in ranking.merge_hybrid(lexical, semantic).collect()}
    assert got == {1: (["s1", "s2", "s3", "s4"], 0.5, 0.8333), 2: ([], 0.1, 0), 3: (["s5"], None, 1.0)}


def test_numbers_in_order(spark):
    df = spark.createDataFrame([(i * 37 % 101, f"v{i}") for i in range(101)], "k int, v string").repartition(6)
    got = relational.numbered(df, [F.desc("k")]).orderBy("n").collect()
    assert [r.n for r in got] == list(range(101)) and [r.k for r in got] == list(range(100, -1, -1))


def plain_greedy(ids, links, passes=20):
    label = {i: i for i in ids}
    for _ in range(passes):
        moved = False
        for i in sorted(ids):
            sums: dict = {}
            for j, w in links.get(i, {}).items():
                sums[label[j]] = sums.get(label[j], 0) + w
            sums.pop(label[i], None)
            best = max(sums.items(), key=lambda x: (x[1], [-ord(c) for c in x[0]]), default=None)
            if best and best[1] > 0:
                label[i], moved = best[0], True
        if not moved:
            break
    return label


def test_greedy_clusters_against_plain(spark):
    rng = random.Random(2)
    ids = [f"v{i:02}" for i in range(40)]
    pairs = {(a, b) for a, b in ((rng.choice(ids), rng.choice(ids)) for _ in range(90)) if a < b}
    edges = spark.createDataFrame([(a, b, "r", "extracted", 1.0) for a, b in sorted(pairs)], "source string, target string, relation string, evidence string, weight double")
    nodes = spark.createDataFrame([(i, "n", "file") for i in ids], "id string, label string, node_type string")
    damped = graph.damped(nodes.select("id"), edges).groupBy("a", "b").agg(F.sum("w").alias("w")).collect()
    links: dict = {}
    for r in damped:
        links.setdefault(r.a, {})[r.b] = r.w
    index = {i: k for k, i in enumerate(ids)}
    a, b, w = (np.array(x) for x in zip(*[(index[r.a], index[r.b], r.w) for r in damped], strict=True))
    found = cluster.greedy_labels(len(ids), a, b, w)
    want = plain_greedy(ids, links)
    groups = lambda label: sorted(sorted(i for i in ids if label(i) == k) for k in {label(i) for i in ids})
    assert groups(lambda i: found[index[i]]) == groups(lambda i: want[i])


def blocks(groups, size, rng, within, across):
    """Random graph of groups with many links inside and few between, as edges."""
    name = lambda g, i: f"g{g:02}n{i:03}"
    pairs = {(name(g, i), name(g, j)) for g in range(groups) for i in range(size) for j in rng.sample(range(size), within) if i < j}
    pairs |= {(name(g, i), name(g, i + 1)) for g in range(groups) for i in range(size - 1)}
    for _ in range(across * groups):
        a, b = rng.sample(range(groups), 2)
        pairs.add(tuple(sorted((name(a, rng.randrange(size)), name(b, rng.randrange(size))))))
    return sorted(pairs)


def graph_of(spark, pairs, extra=()):
    edges = spark.createDataFrame([(a, b, "r", "extracted", 1.0) for a, b in pairs], "source string, target string, relation string, evidence string, weight double")
    nodes = spark.createDataFrame([(i,) for i in sorted({x for p in pairs for x in p} | set(extra))], "id string").withColumn("node_type", F.lit("file"))
    return nodes, edges


def connected(own, pairs):
    reached, open_ = set(), [min(own)]
    near: dict = {}
    for a, b in pairs:
        if a in own and b in own:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    while open_:
        x = open_.pop()
        if x not in reached:
            reached.add(x)
            open_ += near.get(x, [])
    return reached == own


@pytest.mark.parametrize("method", ["greedy", "leiden"])
def test_components_beyond_the_bound_are_clustered_in_rounds(spark, method):
    """A ring and a path, larger and smaller than the bound, small components and a lone node: none is left without a community."""
    pairs = [(f"a{i:02}", f"a{(i + 1) % 30:02}") for i in range(30)] + [(f"b{i:02}", f"b{i + 1:02}") for i in range(24)] + [("c0", "c1")]
    nodes, edges = graph_of(spark, pairs, {"lone"})
    got = {r.id: (r.community, r.parent) for r in cluster.communities(nodes, edges, method, max_nodes=28).collect()}
    assert len(got) == 58 and all(c is not None and p is not None for c, p in got.values())
    assert got["c0"][0] == got["c1"][0] and got["lone"][0] != got["c0"][0]
    kept = {c for c, _ in got.values()}
    assert kept == set(range(len(kept)))
    for c in kept:
        own = {i for i, (k, _) in got.items() if k == c}
        assert len({i[0] for i in own}) == 1 and (method == "greedy" or connected(own, pairs))
    assert cluster.communities(nodes.limit(0), edges.limit(0), method).collect() == []


def test_rounds_are_as_good_as_one_task(spark):
    """Modularity of distributed moves, to the last level and with the last levels in one task, against that of the moves in order."""
    pairs = blocks(6, 16, random.Random(4), 4, 4)
    nodes, edges = graph_of(spark, pairs)
    quality, members = {}, {}
    for name, bound in (("task", 10_000), ("rounds", 0), ("both", 40)):
        found = cluster.communities(nodes, edges, "leiden", max_nodes=bound)
        members[name] = {r.id: r.community for r in found.collect()}
        quality[name] = cluster.modularity(edges, found).first().modularity
    assert quality["rounds"] >= 0.99 * quality["task"] and quality["both"] >= 0.99 * quality["task"] and quality["task"] > 0.6
    for c in set(members["rounds"].values()):
        assert connected({i for i, k in members["rounds"].items() if k == c}, pairs)


def test_nodes_with_one_neighbour_take_no_part_in_rounds(spark, monkeypatch):
    """Stars, a path, pairs and loops: labels of all nodes, of rounds over those with several neighbours only."""
    from loomspan.operators import components as parts

    stars = [(f"h{g}", f"a{g}{i:02}") for g in range(4) for i in range(30)] + [("h0", "h1"), ("h1", "h2"), ("h2", "h0")]
    pairs = stars + [("p1", "p2"), ("p2", "p3"), ("p3", "p4"), ("q2", "q1"), ("q1", "q2"), ("z", "z"), ("h3", "h3"), (None, "n")]
    seen, own = [], parts._labels
    monkeypatch.setattr(parts, "_labels", lambda both, most: seen.extend(r.a for r in both.collect()) or own(both, most))
    got = {r.node: r.component for r in parts.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    least = lambda n: "a300" if n == "h3" or n[:2] == "a3" else "a000" if n[0] in "ah" else {"p": "p1", "q": "q1", "z": "z"}[n[0]]
    assert got == {n: least(n) for p in pairs[:-1] for n in p} and set(seen) == {"h0", "h1", "h2", "p2", "p3"}
    nodes, edges = graph_of(spark, stars)
    moved, settled = [], cluster._settled
    monkeypatch.setattr(cluster, "_settled", lambda links, state, *more: moved.append(state.count()) or settled(links, state, *more))
    for method in ("greedy", "leiden"):
        label = {r.id: r.label for r in cluster.moved_labels(nodes.withColumn("component", F.when(F.substring("id", 2, 1) == "3", "a300").otherwise("a000")), graph.both_ways(edges, "weight"), method, max_nodes=0).collect()}
        assert set(label) == {r.id for r in nodes.collect()} and all(label[a] == label[h] for h, a in stars[:120]) and len(set(label.values())) == 4
    assert max(moved) == 4


def test_two_cliques_and_resolution(spark):
    """Two cliques with one link between them are two communities, one at a resolution of nearly nothing."""
    clique = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(12) for j in range(i + 1, 12)] + [("a0", "b0")]
    nodes, edges = graph_of(spark, clique)
    own = nodes.withColumn("component", F.lit("a0"))
    links = graph.both_ways(edges, "weight")
    groups = lambda df: sorted(sorted(i for i, k in df.items() if k == c) for c in set(df.values()))
    found = {r.id: r.label for r in cluster.moved_labels(own, links, max_nodes=0).collect()}
    assert groups(found) == [sorted(f"{g}{i}" for i in range(12)) for g in "ab"]
    assert len(set(r.label for r in cluster.moved_labels(own, links, resolution=0.001, max_nodes=100).collect())) == 1


def test_no_two_neighbours_move_at_once(spark):
    pairs = blocks(3, 20, random.Random(6), 3, 4)
    nodes, edges = graph_of(spark, pairs)
    links = graph.both_ways(edges, "weight")
    k = links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k"))
    state = k.select("id", "k", F.lit(float(2 * len(pairs))).alias("m2"), F.col("id").alias("label"))
    for turn in range(3):
        state = spark.createDataFrame(cluster._round(links, state, 1.0, turn).collect())
        moved = {r.id for r in state.collect() if r.label != r.before}
        assert moved and not any(a in moved and b in moved for a, b in pairs)


def plain_fold(rows):
    """Every claim against all before it, as dicts."""
    names = ("claim_id", "project_id", "claim_key", "subject", "claim_type", "polarity", "authority", "verification", "admitted", "valid_from", "created_at")
    out, seen = set(), []
    power = lambda r: reconcile.AUTHORITY_SCORE[r["authority"]] + reconcile.VERIFICATION_SCORE[r["verification"]]
    for r in sorted((dict(zip(names, x, strict=True)) for x in rows if x[8]), key=lambda r: (r["valid_from"], r["claim_id"])):
        near = [p for p in seen if p["project_id"] == r["project_id"] and (p["claim_key"] == r["claim_key"] or p["subject"] == r["subject"])]
        for p in sorted(near, key=lambda x: (x["valid_from"], x["created_at"], x["claim_id"]), reverse=True)[:12]:
            if (r["claim_type"], p["claim_type"]) in reconcile.SUPERSEDES and power(r) >= power(p):
                out.add((r["claim_id"], p["claim_id"], "supersedes"))
            if r["polarity"] != p["polarity"]:
                out.add((r["claim_id"], p["claim_id"], "contradicts"))
                loser = p if power(r) > power(p) else r if power(r) < power(p) else None
                if loser is not None:
                    loser["verification"] = "contradicted"
            else:
                out.add((r["claim_id"], p["claim_id"], "confirms"))
        seen.append(r)
    return out


def test_claims_in_order_against_plain(spark):
    """The fold over claims in arrival order sees what the claims before it changed."""
    rng = random.Random(12)
    t0 = datetime(2025, 1, 1)
    kinds, auths, vers = ["bug", "fix", "fact", "decision", "task"], ["repository", "test_verified", "session_derived"], ["verified", "inferred"]
    rows = [
        (f"c{i:03}", f"p{rng.randrange(2)}", f"k{rng.randrange(9)}", f"s{rng.randrange(4)}", rng.choice(kinds), rng.choice(["positive", "negative"]), rng.choice(auths), rng.choice(vers), rng.random() < 0.9, t0 + timedelta(days=rng.randrange(60)), t0 + timedelta(days=i))
        for i in range(160)
    ]
    df = spark.createDataFrame(rows, "claim_id string, project_id string, claim_key string, subject string, claim_type string, polarity string, authority string, verification string, admitted boolean, valid_from timestamp, created_at timestamp")
    got = reconcile.reconcile_in_order(df.repartition(5)).collect()
    assert {(r.claim_id, r.prior_claim_id, r.relation) for r in got} == plain_fold(rows) and len(got) > 500
    assert reconcile.reconcile_in_order(df.limit(0)).collect() == []


@pytest.mark.parametrize(("most", "kinds"), [(15, ["file", "symbol", "section", "module", "bug"]), (21, ["file", "module"])])
def test_display_projection_against_plain(spark, most, kinds):
    """Seeds of each bucket in order, their neighbours in the order of edges, then the rest in order."""
    rng = random.Random(3)
    nodes = [(f"n{i:02}", rng.choice(kinds)) for i in range(40)]
    edges = sorted({(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}", "r") for _ in range(60)})
    chosen, count = [], {}
    for n, k in nodes:
        bucket = {"file": 0, "module": 0, "section": 1}.get(k, 2)
        if count.get(bucket, 0) < most // 3:
            count[bucket] = count.get(bucket, 0) + 1
            chosen.append(n)
    near = [y for s in list(chosen) for a, b, _ in edges for x, y in ((a, b), (b, a)) if x == s]
    for n in [*near, *[n for n, _ in nodes]]:
        if n not in chosen and len(chosen) < most:
            chosen.append(n)
    n, e = spark.createDataFrame([(i, "l", k) for i, k in nodes], "id string, label string, node_type string"), spark.createDataFrame(edges, "source string, target string, relation string")
    got = graph.project_for_display(n, e, most, 7)
    assert {r.id for r in got[0].collect()} == set(chosen) and len(chosen) == most
    assert [tuple(r) for r in got[1].collect()] == [x for x in edges if {x[0], x[1]} <= set(chosen)][:7]
    assert graph.project_for_display(n, e, 40, 100)[0].count() == 40


def test_leiden_parts_are_connected_and_no_worse(spark):
    rng = random.Random(9)
    pairs = sorted({tuple(sorted((f"c{c}n{rng.randrange(9)}", f"c{c}n{rng.randrange(9)}"))) for c in range(4) for _ in range(40)} | {(f"c{c}n0", f"c{(c + 1) % 4}n0") for c in range(4)})
    pairs = [(a, b) for a, b in pairs if a != b]
    edges = spark.createDataFrame([(a, b, "r", "extracted", 1.0) for a, b in pairs], "source string, target string, relation string, evidence string, weight double")
    nodes = spark.createDataFrame([(i, "file") for i in sorted({x for p in pairs for x in p})], "id string, node_type string")
    quality, member = {}, {}
    for method in ("greedy", "leiden"):
        found = cluster.communities(nodes, edges, method)
        member[method] = {r.id: r.community for r in found.collect()}
        quality[method] = cluster.modularity(edges, found).first().modularity
    assert quality["leiden"] >= quality["greedy"] - 1e-9 and quality["leiden"] > 0.4
    for c in set(member["leiden"].values()):
        own = {i for i, k in member["leiden"].items() if k == c}
        reached, open_ = set(), [min(own)]
        while open_:
            x = open_.pop()
            if x not in reached:
                reached.add(x)
                open_ += [b if a == x else a for a, b in pairs if x in (a, b) and a in own and b in own]
        assert reached == own


def test_hybrid_search_end_to_end(spark):
    """Words and vectors meet, signals rank, families count once, a type filter holds where a hit of it is left."""
    from loomspan.plans.search import hybrid_search

    now = datetime(2026, 1, 1)
    rows = [(1, "fact", "Parquet tables", "we store tables", 1), (2, "decision", "Use parquet", "parquet for all tables", 2), (3, "fact", "Parquet 2 tables!", "another copy of the family", 3), (4, "risk", "nothing", "unrelated words", 1), (5, "task", "only by vector", "words", 1)]
    m = spark.createDataFrame([(i, k, t, c, "", now - timedelta(days=d), "verified", "repository") for i, k, t, c, d in rows], "id long, memory_type string, title string, content string, summary string, created_at timestamp, verification string, authority string")
    vectors = spark.createDataFrame([(5, [1.0, 0.0]), (4, [0.0, 1.0])], "id long, embedding array<double>")
    found = hybrid_search(m, ranking.Request(query="parquet tables", now=now), 5, [1.0, 0.1], vectors).collect()
    ids = [r.id for r in sorted(found, key=lambda r: r["rank"])]
    # By hand: 4 has 0.158 of its vector, 0.08 of its kind and 0.08 of its age; 2 has 0.021 of its words, 0.22 and 0.068.
    assert ids == [1, 5, 4, 2] and sorted(r["rank"] for r in found) == [1, 2, 3, 4] and {r.level for r in found} == {"overview"}
    typed = hybrid_search(m, ranking.Request(query="parquet tables", now=now, types=("decision",)), 5).collect()
    assert [r.id for r in typed] == [2]
    assert len(hybrid_search(m, ranking.Request(query="parquet", now=now, types=("open_question",)), 5).collect()) >= 1


def test_projects_share_a_display(spark):
    """Each project gets what is left over, layers get half each, and of a node in two graphs the later one stays."""
    node, edge = "id string, label string, node_type string, source_type string, source_id string", "source string, target string, relation string, evidence string, weight double"

    def ring(name, n):
        nodes = [(f"{name}{i}", f"{name} {i}", "file", "t", "s") for i in range(n)] + [("shared", name, "file", "t", "s")]
        return spark.createDataFrame(nodes, node), spark.createDataFrame([(f"{name}{i}", f"{name}{(i + 1) % n}", "r", "extracted", 1.0 + i) for i in range(n)], edge)

    a, b = ring("a", 4), ring("b", 6)
    nodes, edges = graph.merged_projects([a, b], 8, 7)
    assert nodes.count() <= 8 and edges.count() <= 7 and {r.id[0] for r in nodes.collect()} >= {"a", "b"}
    nodes, edges = graph.merged_projects([a, b], 100, 100)
    assert nodes.count() == 11 and edges.count() == 10 and nodes.where("id = 'shared'").first().label == "b"
    assert graph.merged_projects([a, b], 5, 4)[0].where("id like 'b%'").isEmpty()
    nodes, _ = graph.layered([a], [b], 8, 8)
    assert 0 < nodes.where("id like 'a%'").count() <= 4 and 0 < nodes.where("id like 'b%'").count() <= 4 and nodes.count() <= 8
    assert graph.layered([], [], 5, 5) is None and graph.layered([], [b], 50, 50)[0].count() == 7


def test_drafts_are_persisted(spark):
    """Admitted drafts, each once, with provenance of stored events, a claim, proofs, embeddings and jobs; again nothing new."""
    kind = "memory_id string, session_id string, memory_type string, title string, content string, metadata map<string,string>, provenance_event_ids array<string>"
    rows = [("m1", "s", "fact", "One", "a b", {"claimKey": "fact:k"}, ["e1", "gone"]), ("m2", "s", "fact", "One", "a b", {"claimKey": "fact:k"}, ["e2"]), ("m3", "s", "bug", "Two", "c", {"belief.admit": "false"}, []), ("m4", "s", "task", "Three", "d", {}, [])]
    events = spark.createDataFrame([("s", f"e{i}", "said", None, None, None, datetime(2025, 1, i)) for i in (1, 2)], "session_id string, event_id string, message string, command string, tool_name string, file_path string, created_at timestamp")
    none, sessions = spark.createDataFrame([], "memory_id string"), spark.createDataFrame([("s",)], "session_id string")
    got = proofs.persist(spark.createDataFrame(rows, kind), events, none, sessions)
    ids = lambda name: sorted(r.memory_id for r in got[name].select("memory_id").distinct().collect())
    assert ids("memories") == ids("claims") == ids("proofs") == ids("embeddings") == ["m1", "m4"] and ids("provenance") == ["m1"]
    assert sorted((r.memory_id, r.source_ref, r.excerpt) for r in got["proofs"].collect()) == [("m1", "session_event:e1", "said"), ("m1", "session_event:gone", None), ("m4", "memory", None)]
    assert sorted(r.job_type for r in got["jobs"].collect()) == ["reconcile_claims", "sync_vectors"]
    again = proofs.persist(spark.createDataFrame(rows, kind), events, got["claims"].select("memory_id"), sessions)
    assert again["claims"].collect() == [] and again["proofs"].collect() == []
