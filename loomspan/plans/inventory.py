"""More named queries: sources' predicates, proofs, projections, ranking signals, graph parts, queues and scalars, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import catalogue, text
from loomspan.operators import claims, components, context, events, graph, nesting, proofs, ranking, reconcile, relational, retrieval, traverse
from loomspan.plans.catalog import CANON, CLASS_SQL, EPISODES_SQL, ITEMS_SQL, NOW, SEARCH_SQL, SEGMENTS_SQL, SIGNALS_SQL, TYPE_SQL, _cover_sql, _items, _score_sql, query, six
from loomspan.plans.lineage import read, shared_folder
from loomspan.schemas import lookup
from loomspan.scope import Scope, scoped, with_global_fallback
from loomspan.sources import repository, sessions
from loomspan.sources.adapters import GRAPH_SQL, MEMORIES_SQL, PAGE_NODES_SQL, TELEMETRY_SQL, memories, order_graph, page_nodes, telemetry
from loomspan.sources.postings import PostingIndex
from loomspan.sources.vectors import VectorIndex
from loomspan.streaming import jobs

# --- A: sources and sinks ---------------------------------------------------------

EXTENSIONS = ("py", "rs", "TS", "tsx", "md", "png", "mp4", "docx", "xlsx", "pptx", "pdf", "lock", "env", "min.js", "jl", "ps1")
PATHS_SQL = f"pth AS (SELECT page_id, CASE WHEN page_id % 19 = 0 THEN 'node_modules/' ELSE 'src/' END || 'f' || page_id || '.' || ({list(EXTENSIONS)})[CAST(page_id % 16 + 1 AS INT)] AS path, html FROM pages)"
EXT_SQL = "regexp_extract(lower(path), '\\.([^./]+)$', 1)"


def _paths(spark, sf):
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("page_id") % 16 + 1).cast("int"))
    folder = F.when(F.col("page_id") % 19 == 0, "node_modules/").otherwise("src/")
    return read(spark, sf, "pages").select("page_id", F.concat(folder, F.lit("f"), F.col("page_id").cast("string"), F.lit("."), ext).alias("path"), "html")


@query("A06_file_kind", f"WITH {PATHS_SQL} SELECT page_id, CASE WHEN {EXT_SQL} IN ('py', 'rs', 'ts', 'tsx', 'js', 'jl', 'ps1') THEN 'code' WHEN {EXT_SQL} = 'md' THEN 'document' WHEN {EXT_SQL} = 'png' THEN 'image' WHEN {EXT_SQL} = 'mp4' THEN 'media' WHEN {EXT_SQL} = 'docx' THEN 'office_document' WHEN {EXT_SQL} = 'xlsx' THEN 'spreadsheet' WHEN {EXT_SQL} = 'pptx' THEN 'presentation' WHEN {EXT_SQL} = 'pdf' THEN 'pdf' ELSE 'unsupported' END AS kind FROM pth")
def a06(spark, sf):
    return _paths(spark, sf).select("page_id", repository.file_kind(F.col("path")).alias("kind"))


@query("A07_ignored_files", f"WITH {PATHS_SQL} SELECT page_id FROM pth WHERE starts_with(path, 'node_modules/') OR ends_with(path, '.min.js')")
def a07(spark, sf):
    return _paths(spark, sf).where(repository.is_ignored(F.col("path"))).select("page_id")


@query("A40_language", f"WITH {PATHS_SQL} SELECT page_id, CASE {EXT_SQL} WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'js' THEN 'javascript' WHEN 'jl' THEN 'julia' END AS language FROM pth")
def a40(spark, sf):
    return _paths(spark, sf).select("page_id", repository.language(F.col("path")).alias("language"))


@query("A17_manifest", f"WITH {PATHS_SQL} SELECT path, sha256(html) AS hash FROM pth")
def a17(spark, sf):
    return repository.manifest(_paths(spark, sf).select("path", F.col("html").cast("binary").alias("content")))


@query("A04_file_dates", "WITH f AS (SELECT event_id, event_id % 11 = 0 AS undated, CASE WHEN event_id % 11 = 1 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS moment FROM events) SELECT event_id FROM f WHERE undated OR moment BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:30:00'")
def a04(spark, sf):
    i = F.col("event_id")
    rollout = F.concat(F.lit("a/rollout-"), F.date_format("ts", "yyyy-MM-dd'T'HH-mm-ss"), F.lit("-x.jsonl"))
    session = F.concat(F.lit("session-"), F.date_format("ts", "yyyy-MM-dd'T'HH-mm"), F.lit(".json"))
    name = F.when(i % 11 == 0, "notes.jsonl").when(i % 11 == 1, session).otherwise(rollout)
    return read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).where(sessions.in_date_range(name, "2024-01-05 00:00:00", "2024-01-20 12:30:00")).select("event_id")


@query("A02_last_messages", "WITH m AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE text IS NOT NULL) SELECT CAST(conv_id AS VARCHAR) AS session_id, left(string_agg(text, chr(10) ORDER BY turn), 1500) AS summary FROM m WHERE n <= 5 GROUP BY 1")
def a02(spark, sf):
    c = read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("ordinal"), F.col("text").alias("message"))
    return sessions.last_messages(c)


@query("A32_exit_codes", f"WITH {TELEMETRY_SQL} SELECT event_id, CASE WHEN ordinal % 3 = 0 THEN exit_code END AS exit_code, CASE WHEN ordinal % 3 = 0 THEN 'ls -l ' || ordinal END AS command, CASE WHEN ordinal % 3 = 0 THEN 'line ' || ordinal WHEN ordinal % 3 = 1 THEN 'plain' END AS body FROM ev")
def a32(spark, sf):
    n, code = F.col("ordinal").cast("string"), F.col("exit_code").cast("string")
    whole = F.concat(F.lit("Command: ls -l "), n, F.lit("\nProcess exited with code "), code, F.lit("\nOutput:\nOutput:\nline "), n, F.lit("\n"))
    e = telemetry(spark, sf).withColumn("raw", F.when(F.col("ordinal") % 3 == 0, whole).when(F.col("ordinal") % 3 == 1, " plain\n").otherwise("\t\n"))
    return e.select("event_id", sessions.exit_code_of(F.col("raw")).alias("exit_code"), sessions.command_of(F.col("raw")).alias("command"), F.regexp_replace(sessions.output_body(F.col("raw")), "^Output:\n", "").alias("body"))


@query("H03_record_messages", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a' || chr(10) || 'b' || event_id WHEN 1 THEN 'said' WHEN 2 THEN 'out' END AS message FROM events")
def h03(spark, sf):
    i, n = F.col("event_id"), F.col("event_id").cast("string")
    parts = F.concat(F.lit('[{"text":"a"},{"other":1},{"text":"b'), n, F.lit('"}]'))
    content = F.when(i % 4 == 0, parts).when(i % 4 == 1, "said").when(i % 4 == 3, "[]")
    return read(spark, sf, "events").select("event_id", F.when(i % 4 == 2, sessions.output_body(F.lit("x\nOutput:\nout"))).otherwise(sessions.content_text(content)).alias("message"))


@query("A19_batch_duplicates", "WITH b AS (SELECT event_id, user_id AS s, CAST(event_id // 2 AS VARCHAR) AS k, event_id AS p FROM events), st AS (SELECT DISTINCT user_id AS s, CAST(event_id // 2 AS VARCHAR) AS k FROM events WHERE event_id % 7 = 0) SELECT event_id, (row_number() OVER (PARTITION BY b.s, b.k ORDER BY p) > 1 OR st.k IS NOT NULL) AS duplicate FROM b LEFT JOIN st ON b.s = st.s AND b.k = st.k")
def a19(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.expr("cast(event_id div 2 as string)").alias("idempotency_key"), F.col("event_id").cast("string").alias("event_id"), F.col("event_id").alias("position"))
    stored = e.where("position % 7 = 0").withColumn("event_id", F.concat(F.lit("x"), "event_id"))
    return events.append_once(stored, e).select(F.col("position").alias("event_id"), "duplicate")


@query("A25_node_link", f"WITH {GRAPH_SQL} SELECT kind, count(*) AS n, sum(length(json))::BIGINT AS chars FROM (SELECT 'node' AS kind, '{{\"id\":\"' || id || '\",\"label\":\"' || label || '\",\"node_type\":\"' || node_type || '\"}}' AS json FROM nodes UNION ALL SELECT 'link', '{{\"source\":\"' || source || '\",\"target\":\"' || target || '\",\"relation\":\"' || relation || '\"}}' FROM edges) GROUP BY 1")
def a25(spark, sf):
    from loomspan.sources.store import node_link

    n, e = order_graph(spark, sf)
    rows = node_link(n.select("id", "label", "node_type"), e.select("source", "target", "relation"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("json")).alias("chars"))


KIND_SQL = "(['Fact', ' decision', 'implementation_detail', 'open_question', '', 'a b-c'])[CAST(label % 6 + 1 AS INT)]"
COLLECTION_SQL = f"CASE {KIND_SQL} WHEN '' THEN 'all' WHEN 'implementation_detail' THEN 'impl_detail' WHEN 'open_question' THEN 'open_q' ELSE regexp_replace(lower({KIND_SQL}), '[^a-z0-9_]', '_', 'g') END"


def _typed_vectors(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("Fact", " decision", "implementation_detail", "open_question", "", "a b-c"))), (F.col("label") % 6 + 1).cast("int"))
    return read(spark, sf, "embeddings").where("label >= 0").select(F.col("vec_id").alias("id"), kind.alias("memory_type"))


@query("A35_vector_fan_out", f"WITH v AS (SELECT vec_id AS id, {COLLECTION_SQL} AS c FROM embeddings WHERE label >= 0) SELECT DISTINCT id, unnest(['all', c, 'project_p1_all', 'project_p1_' || c]) AS collection FROM v")
def a35(spark, sf):
    return retrieval.fan_out(_typed_vectors(spark, sf), retrieval.scope_suffix("p1")).select("id", "collection")


@query("A26_collection_sizes", f"WITH v AS (SELECT vec_id AS id, {COLLECTION_SQL} AS c FROM embeddings WHERE label >= 0), f AS (SELECT DISTINCT id, unnest(['all', c]) AS collection FROM v) SELECT collection, count(*) AS n FROM f GROUP BY 1")
def a26(spark, sf):
    return retrieval.fan_out(_typed_vectors(spark, sf)).groupBy("collection").agg(F.count("*").alias("n"))


@query("A27_vector_versions", "SELECT id, max(version)::INT AS version FROM (SELECT vec_id AS id, 1 AS version, false AS gone FROM embeddings UNION ALL SELECT vec_id, 2, vec_id % 4 = 0 FROM embeddings WHERE vec_id % 2 = 0) GROUP BY id HAVING NOT arg_max(gone, version)")
def a27(spark, sf):
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.lit(1).alias("version"), F.lit(False).alias("deleted"))
    again = v.where("id % 2 = 0").select("id", F.lit(2).alias("version"), (F.col("id") % 4 == 0).alias("deleted"))
    return relational.upsert(v, again, ["id"], ["version"]).where("not deleted").select("id", "version")


@query("A30_ordered_events", f"WITH {TELEMETRY_SQL} SELECT session_id, event_id, (row_number() OVER w)::INT AS place FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY created_at, ordinal) QUALIFY row_number() OVER w <= 100")
def a30(spark, sf):
    from pyspark.sql import Window

    order = [F.asc("created_at"), F.asc("ordinal")]
    top = relational.top_per_key(telemetry(spark, sf), ["session_id"], order, 100)
    return top.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(*order))).select("session_id", "event_id", "place")


@query("A31_newest_memories", f"WITH {MEMORIES_SQL} SELECT id, session_ids[1] AS session_id FROM mem WHERE project_id = 'src1' ORDER BY created_s DESC, id LIMIT 25000")
def a31(spark, sf):
    m = relational.filtered(memories(spark, sf), {"project_id": "src1"})
    return m.orderBy(F.desc("created_at"), "id").limit(25_000).select("id", F.get("session_ids", F.lit(0)).alias("session_id"))


# --- proofs and provenance -----------------------------------------------------------

PROOF_SQL = f"""{TELEMETRY_SQL},
pm AS (SELECT doc_id AS memory_id, CASE WHEN doc_id % 5 = 0 THEN [] WHEN doc_id % 5 = 1 THEN [CAST(doc_id AS VARCHAR), CAST(doc_id + 1 AS VARCHAR), CAST(doc_id AS VARCHAR)] ELSE [CAST(doc_id * 3 AS VARCHAR), 'gone' || doc_id] END AS ids,
  CASE WHEN doc_id % 3 = 0 THEN 'key:' || doc_id END AS claim_key, CASE WHEN doc_id % 4 = 0 THEN 'tool_result' END AS proof_type, CASE WHEN doc_id % 2 = 0 THEN 'fact_claim' END AS derivation,
  CASE doc_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS admit, source FROM documents),
named AS (SELECT memory_id, unnest(ids) AS event_id, generate_subscripts(ids, 1) - 1 AS place FROM pm),
txt AS (SELECT event_id, session_id, created_at, left(concat_ws(' | ', message, command, tool_name, file_path), 500) AS excerpt FROM ev),
prov AS (SELECT n.memory_id, t.session_id, n.event_id AS session_event_id, t.excerpt, min(n.place)::INT AS place FROM named n JOIN txt t USING (event_id) GROUP BY ALL)"""


def _proof_memories(spark, sf):
    i, s = F.col("doc_id"), F.col("doc_id").cast("string")
    ids = F.when(i % 5 == 0, F.array().cast("array<string>")).when(i % 5 == 1, F.array(s, (i + 1).cast("string"), s)).otherwise(F.array((i * 3).cast("string"), F.concat(F.lit("gone"), s)))
    entries = {"claimKey": F.when(i % 3 == 0, F.concat(F.lit("key:"), s)), "proofType": F.when(i % 4 == 0, "tool_result"), "derivation": F.when(i % 2 == 0, "fact_claim"), "belief.admit": F.when(i % 3 == 0, "true").when(i % 3 == 1, "false")}
    meta = F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v.cast("string"))])
    return read(spark, sf, "documents").select(i.alias("memory_id"), F.concat(F.lit("c"), s).alias("claim_id"), ids.alias("provenance_event_ids"), F.map_filter(meta, lambda k, v: v.isNotNull()).alias("metadata"), "source")


def _provenance(spark, sf):
    return proofs.provenance_rows(_proof_memories(spark, sf), telemetry(spark, sf))


@query("C07_provenance_join", f"WITH {PROOF_SQL} SELECT memory_id, place, session_id, session_event_id, excerpt FROM prov")
def c07(spark, sf):
    return _provenance(spark, sf)


@query("B12_proof_rows", f"WITH {PROOF_SQL} SELECT 'c' || p.memory_id AS claim_id, n.event_id AS session_event_id, coalesce(proof_type, 'session_event') AS proof_type, coalesce('session_event:' || n.event_id, claim_key, 'memory') AS source_ref, t.excerpt, epoch_us(t.created_at) AS proof_us FROM pm p LEFT JOIN named n USING (memory_id) LEFT JOIN txt t USING (event_id)")
def b12(spark, sf):
    rows = proofs.proof_rows(_proof_memories(spark, sf), telemetry(spark, sf))
    return rows.select("claim_id", "session_event_id", "proof_type", "source_ref", "excerpt", F.unix_micros("proof_time").alias("proof_us"))


@query("B13_proof_handles", f"WITH {PROOF_SQL} SELECT p.memory_id, coalesce(string_agg('session_event:' || v.session_event_id, ',' ORDER BY v.place), claim_key, derivation, 'memory') AS refs, count(v.session_event_id) AS with_event, coalesce(proof_type, 'session_event') AS proof_type FROM pm p LEFT JOIN prov v USING (memory_id) GROUP BY p.memory_id, claim_key, derivation, proof_type")
def b13(spark, sf):
    h = proofs.proof_handles(_proof_memories(spark, sf), _provenance(spark, sf))
    return h.select("memory_id", F.array_join(F.transform("handles", lambda x: x["source_ref"]), ",").alias("refs"), F.size(F.filter("handles", lambda x: x["session_event_id"].isNotNull())).cast("long").alias("with_event"), F.get("handles", F.lit(0))["proof_type"].alias("proof_type"))


@query("G22_provenance_preview", f"WITH {PROOF_SQL} SELECT memory_id, session_event_id, excerpt, count(*) OVER (PARTITION BY memory_id) AS events FROM prov QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY place, session_event_id) = 1")
def g22(spark, sf):
    return proofs.provenance_preview(_provenance(spark, sf)).select("memory_id", "session_event_id", "excerpt", "events")


@query("G18_provenance_append", f"WITH {PROOF_SQL} SELECT memory_id, session_event_id FROM prov")
def g18(spark, sf):
    p = _provenance(spark, sf)
    return proofs.append_provenance(p.where("memory_id % 2 = 0"), p.unionByName(p.where("memory_id % 3 = 0"))).select("memory_id", "session_event_id")


@query("D20_provenance_arrays", f"WITH {PROOF_SQL} SELECT memory_id, string_agg(session_event_id, ',' ORDER BY place) AS events FROM prov GROUP BY 1")
def d20(spark, sf):
    return _provenance(spark, sf).groupBy("memory_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "session_event_id"))), lambda x: x["session_event_id"]), ",").alias("events"))


@query("A37_ordered_proofs", f"WITH {PROOF_SQL} SELECT memory_id, place, session_event_id FROM prov WHERE memory_id IN (1, 2, 7, 11, 16) ORDER BY memory_id, place")
def a37(spark, sf):
    return _provenance(spark, sf).where(F.col("memory_id").isin(1, 2, 7, 11, 16)).orderBy("memory_id", "place").select("memory_id", "place", "session_event_id")


@query("B09_belief_admitted", f"WITH {PROOF_SQL} SELECT memory_id FROM pm WHERE coalesce(admit, 'true') = 'true'")
def b09(spark, sf):
    return _proof_memories(spark, sf).where(proofs.belief_admitted(F.col("metadata"))).select("memory_id")


@query("B10_claim_projection", f"WITH {PROOF_SQL} SELECT memory_id, coalesce(claim_key, 'fact:' || memory_id) AS claim_key, split_part(coalesce(claim_key, 'fact:' || memory_id), ':', 2) AS subject, 'fact' AS predicate, 'positive' AS polarity, 'unverified' AS verification, coalesce(admit, 'true') = 'true' AS admitted FROM pm")
def b10(spark, sf):
    m = _proof_memories(spark, sf).withColumns({"session_id": F.lit("s"), "memory_type": F.lit("fact")})
    return proofs.claim_projection(m).select("memory_id", "claim_key", "subject", "predicate", "polarity", "verification", "admitted")


@query("B14_hit_projection", f"WITH {PROOF_SQL} SELECT memory_id, CASE WHEN memory_id % 7 = 0 THEN 'own' ELSE claim_key END AS claim_key, proof_type FROM pm")
def b14(spark, sf):
    none = F.lit(None).cast("string")
    m = _proof_memories(spark, sf).withColumns({"claim_key": F.when(F.col("memory_id") % 7 == 0, "own"), "authority": none, "verification": none})
    return proofs.hit_projection(m).select("memory_id", "claim_key", "proof_type")


@query("I08_claims_backfill", f"WITH {PROOF_SQL} SELECT p.memory_id, left(sha256('claim:' || p.memory_id), 32) AS claim_id, coalesce(claim_key, 'fact:' || p.memory_id) AS claim_key, greatest(len(ids), 1) AS proofs FROM pm p WHERE p.memory_id % 6 <> 0")
def i08(spark, sf):
    m = _proof_memories(spark, sf).drop("claim_id").withColumns({"session_id": F.lit("s"), "memory_type": F.lit("fact")})
    made, rows = proofs.backfill(m, m.where("memory_id % 6 = 0").select("memory_id"), telemetry(spark, sf))
    return made.join(rows.groupBy("claim_id").agg(F.count("*").alias("proofs")), "claim_id").select("memory_id", "claim_id", "claim_key", "proofs")


@query("A38_memory_details", f"""WITH {PROOF_SQL}, k AS (SELECT 'c' || (doc_id % 40) AS source, 'c' || (doc_id % 9) AS target FROM documents WHERE doc_id % 3 = 0), ends AS (SELECT source AS id FROM k UNION ALL SELECT target FROM k WHERE source <> target)
  SELECT p.memory_id, 'c' || p.memory_id AS claim_id, (SELECT count(*) FROM ends WHERE id = 'c' || p.memory_id) AS active_conflicts, coalesce((SELECT string_agg(session_event_id, ',' ORDER BY place) FROM prov v WHERE v.memory_id = p.memory_id), '') AS provenance,
    (SELECT string_agg(DISTINCT r, ',' ORDER BY r) FROM (SELECT coalesce('session_event:' || n.event_id, p.claim_key, 'memory') AS r FROM (SELECT 1) LEFT JOIN named n ON n.memory_id = p.memory_id)) AS proofs
  FROM pm p WHERE p.memory_id IN (1, 3, 5, 6, 8, 39)""")
def a38(spark, sf):
    m, e = _proof_memories(spark, sf), telemetry(spark, sf)
    i = F.col("doc_id")
    conflicts = read(spark, sf, "documents").where(i % 3 == 0).select(F.concat(F.lit("c"), (i % 40).cast("string")).alias("source"), F.concat(F.lit("c"), (i % 9).cast("string")).alias("target"))
    out = proofs.memory_details(m.select("memory_id"), m.select("memory_id", "claim_id"), conflicts, _provenance(spark, sf), proofs.proof_rows(m, e), [1, 3, 5, 6, 8, 39])
    return out.select("memory_id", "claim_id", "active_conflicts", F.array_join("provenance", ",").alias("provenance"), F.array_join("proofs", ",").alias("proofs"))


# --- B, C, D: predicates, joins, aggregations ------------------------------------------


@query("B02_membership", f"WITH {MEMORIES_SQL} SELECT id FROM mem WHERE memory_type IN ('fact', 'fix')")
def b02(spark, sf):
    return relational.filtered(memories(spark, sf), None, {"memory_type": ("fact", "fix"), "project_id": ()}).select("id")


@query("B04_time_range", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-09 12:00:00'")
def b04(spark, sf):
    from datetime import UTC, datetime

    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return relational.filtered(e, at="ts", since=datetime(2024, 1, 3, tzinfo=UTC), until=datetime(2024, 1, 9, 12, tzinfo=UTC)).select("event_id")


def _tenants(spark, sf):
    c = F.col("c_custkey")
    return read(spark, sf, "customer").select(c, F.concat(F.lit("o"), (c % 3).cast("string")).alias("organization_id"), F.concat(F.lit("t"), (c % 2).cast("string")).alias("team_id"), F.concat(F.lit("p"), (c % 5).cast("string")).alias("project_id"))


@query("B05_tenant_scope", "SELECT c_custkey, c_custkey % 5 = 3 AS in_project FROM customer WHERE c_custkey % 3 = 1 AND c_custkey % 2 = 0")
def b05(spark, sf):
    t = _tenants(spark, sf)
    own = scoped(t, Scope("o1", "t0").override("p3")).select("c_custkey", F.lit(True).alias("in_project"))
    return scoped(t, Scope("o1", "t0")).select("c_custkey").join(own, "c_custkey", "left").na.fill(False)


@query("E41_global_fallback", "SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0")
def e41(spark, sf):
    t = _tenants(spark, sf)
    return with_global_fallback(t.where("project_id = 'none'"), t.where("project_id = 'p0'")).select("c_custkey")


@query("B08_json_paths", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def b08(spark, sf):
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


ID_SQL = "CASE WHEN regexp_full_match(lower(trim({c}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), '[a-z0-9._-]{{1,64}}') THEN lower(trim({c}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) END"


@query("B18_provider_ids", f"SELECT doc_id, {ID_SQL.format(c='text')} AS provider, {ID_SQL.format(c='source')} AS source_provider FROM documents")
def b18(spark, sf):
    return read(spark, sf, "documents").select("doc_id", events.provider_id(F.col("text")).alias("provider"), events.provider_id(F.col("source")).alias("source_provider"))


@query("B22_noisy_paths", f"WITH {PAGE_NODES_SQL} SELECT page_id FROM pn WHERE contains(lower(p), 'build/')")
def b22(spark, sf):
    n = page_nodes(spark, sf)
    path = F.coalesce(F.col("metadata")["fullPath"], F.col("metadata")["sourceFile"], F.element_at(F.split("id", "[:#]"), 2))
    return n.where(graph.is_noisy_path(path)).select("page_id")


@query("B15_persistable_edges", "WITH u AS (SELECT doc_id, 'memory:' || left(md5(text), 8) || '-' || substr(md5(text), 9, 4) || '-' || substr(md5(text), 13, 4) || '-' || substr(md5(text), 17, 4) || '-' || substr(md5(text), 21, 12) AS a, (['related_to','confirms','calls','supersedes'])[CAST(doc_id % 4 + 1 AS INT)] AS relation FROM documents WHERE text IS NOT NULL) SELECT doc_id, substr(a, 8) AS from_id, relation FROM u WHERE relation <> 'calls' AND doc_id % 5 <> 0")
def b15(spark, sf):
    h = F.md5(F.col("text").cast("binary"))
    parts = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    rel = F.element_at(F.array(*map(F.lit, ("related_to", "confirms", "calls", "supersedes"))), (F.col("doc_id") % 4 + 1).cast("int"))
    e = read(spark, sf, "documents").where("text is not null").select("doc_id", F.concat(F.lit("memory:"), parts).alias("source"), F.when(F.col("doc_id") % 5 == 0, F.lit("file:x")).otherwise(F.concat(F.lit("memory:"), parts)).alias("target"), rel.alias("relation"))
    return graph.persistable(e).select("doc_id", "from_id", "relation")


@query("B16_stale_retention", f"WITH {GRAPH_SQL} SELECT id FROM nodes WHERE NOT (node_type = 'order' AND CAST(split_part(id, ':', 2) AS BIGINT) % 3 = 0) UNION SELECT 'fresh:1'")
def b16(spark, sf):
    n, e = order_graph(spark, sf)
    number = F.split_part("id", F.lit(":"), F.lit(2)).cast("long")
    n = n.withColumn("source_file", F.when((F.col("node_type") == "order") & (number % 3 == 0), "old.py").otherwise(F.col("id")))
    e = e.withColumn("source_file", F.col("source"))
    fresh = n.limit(1).withColumns({"id": F.lit("fresh:1"), "source_file": F.lit("old.py")})
    touched = spark.createDataFrame([("old.py",)], "path string")
    return graph.incremental_sync(n, e, fresh, e.limit(0), touched)[0].select("id")


@query("C09_update_from", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'kept' ELSE o.first END AS superseded_by FROM customer LEFT JOIN (SELECT o_custkey, min(CAST(o_orderkey AS VARCHAR)) AS first FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def c09(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "kept").alias("superseded_by"))
    u = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").cast("string").alias("superseded_by"))
    return relational.set_once(c, u, "c_custkey", "superseded_by")


@query("C10_linked_max_weight", "WITH e AS (SELECT o_custkey % 100 AS a, o_orderkey % 100 AS b, o_totalprice AS w FROM orders), u AS (SELECT a AS id, b AS linked, w FROM e UNION ALL SELECT b, a, w FROM e) SELECT linked, round(max(w), 2)::DOUBLE AS weight FROM u WHERE id IN (1, 2, 3) GROUP BY 1")
def c10(spark, sf):
    e = read(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("a"), (F.col("o_orderkey") % 100).alias("b"), F.col("o_totalprice").cast("double").alias("w"))
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    return relational.linked_max(e, "a", "b", "w", ids).select("linked", F.round("weight", 2).alias("weight"))


@query("D05_session_max_weight", "WITH e AS (SELECT o_custkey % 100 AS a, o_orderkey % 100 AS b, o_totalprice AS w FROM orders), u AS (SELECT a AS id, w FROM e UNION ALL SELECT b, w FROM e) SELECT id, round(max(w), 2)::DOUBLE AS weight FROM u GROUP BY 1")
def d05(spark, sf):
    e = read(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("a"), (F.col("o_orderkey") % 100).alias("b"), F.col("o_totalprice").cast("double").alias("w"))
    return relational.either_end_max(e, "a", "b", "w").select("id", F.round("weight", 2).alias("weight"))


MENTION_SQL = "WITH w AS (SELECT doc_id, text, regexp_extract(coalesce(text, ''), '^[A-Za-z0-9]+') AS w FROM documents), f AS (SELECT DISTINCT 'src/' || w || '.py' AS path, w || '.py' AS name FROM w WHERE w <> ''), m AS (SELECT doc_id, w || '.py and ' || coalesce(text, '') AS t FROM w) SELECT 'memory:' || doc_id AS source, 'file:' || path AS target FROM m JOIN f ON contains(t, name)"


@query("C14_contains_join", MENTION_SQL)
def c14(spark, sf):
    text_ = F.coalesce("text", F.lit(""))
    d = read(spark, sf, "documents").withColumn("w", F.regexp_extract(text_, "^[A-Za-z0-9]+", 0))
    files = d.where("w <> ''").select(F.concat(F.lit("src/"), "w", F.lit(".py")).alias("path")).distinct()
    m = d.select(F.col("doc_id").alias("memory_id"), F.lit("").alias("title"), F.concat("w", F.lit(".py and "), text_).alias("content"))
    return graph.mention_edges(m, files).select("source", "target")


@query("C18_revalidated_hits", f"WITH {MEMORIES_SQL} SELECT vec_id AS id FROM embeddings WHERE vec_id IN (SELECT id FROM mem WHERE admitted)")
def c18(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id")).join(memories(spark, sf).where("admitted").select("id"), "id", "left_semi")


@query("C20_edge_injection", f"WITH {GRAPH_SQL}, x AS (SELECT 'customer:' || c_custkey AS source, 'nation:' || (c_custkey % 40) AS target, 'confirms' AS relation, (c_custkey % 100) / 100.0::DOUBLE AS weight FROM c) SELECT source, target, weight FROM x WHERE target IN (SELECT id FROM nodes) ORDER BY weight DESC, source, target LIMIT 50")
def c20(spark, sf):
    n, e = order_graph(spark, sf)
    c = F.col("c_custkey")
    extra = read(spark, sf, "customer").select(F.concat(F.lit("customer:"), c.cast("string")).alias("source"), F.concat(F.lit("nation:"), (c % 40).cast("string")).alias("target"), F.lit("confirms").alias("relation"), F.lit("inferred").alias("evidence"), ((c % 100) / 100.0).alias("weight"))
    return graph.inject(n, e.limit(0), extra, 50).select("source", "target", "weight")


@query("C21_edges_of_ids", f"WITH {GRAPH_SQL} SELECT source, target, 'out' AS direction, source AS id FROM edges WHERE source IN ('nation:1', 'nation:2') UNION ALL SELECT source, target, 'in', target FROM edges WHERE target IN ('nation:1', 'nation:2')")
def c21(spark, sf):
    _, e = order_graph(spark, sf)
    ids = spark.createDataFrame([("nation:1",), ("nation:2",)], "id string")
    found = relational.other_ends(e, "source", "target", ids)
    out = F.col("direction") == "out"
    return found.select(F.when(out, F.col("id")).otherwise(F.col("other")).alias("source"), F.when(out, F.col("other")).otherwise(F.col("id")).alias("target"), "direction", "id")


@query("D07_active_conflicts", "WITH e AS (SELECT user_id AS a, event_id % 97 AS b FROM events WHERE event_type = 'error') SELECT id, count(*) AS n FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e WHERE a <> b) WHERE id IN (SELECT s_suppkey FROM supplier) GROUP BY 1")
def d07(spark, sf):
    e = read(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("a"), (F.col("event_id") % 97).alias("b"))
    return relational.either_end_counts(e, "a", "b").join(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), "id", "left_semi")


@query("D12_community_labels", f"WITH {GRAPH_SQL}, m AS (SELECT id, node_type, CAST(abs(hash(id)) % 1 AS INT) AS c FROM nodes) SELECT upper(node_type[1]) || node_type[2:] || ' cluster (' || (SELECT count(*) FROM nodes) || ' nodes)' AS label FROM (SELECT node_type, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, node_type LIMIT 1)")
def d12(spark, sf):
    n, e = order_graph(spark, sf)
    return graph.community_figures(n.select("id", F.lit(0).alias("community")), n, e).select("label")


@query("D15_episode_mix", f"WITH {TELEMETRY_SQL}, {EPISODES_SQL}, ep AS (SELECT session_id, episode, any_value(t) AS t FROM eps GROUP BY 1, 2) SELECT session_id, count(*) FILTER (t = 'conversation') AS conversation, count(*) FILTER (t = 'implementation') AS implementation, count(*) FILTER (t = 'debugging') AS debugging FROM ep GROUP BY 1 HAVING count(*) >= 2")
def d15(spark, sf):
    e = events.materialise_episodes(events.episodes_of(telemetry(spark, sf), gap_seconds=86400, cap=2))
    mix = claims.reflections(e).select("session_id", F.regexp_extract("content", "conversation=(\\d+)", 1).cast("long").alias("conversation"), F.regexp_extract("content", "implementation=(\\d+)", 1).cast("long").alias("implementation"), F.regexp_extract("content", "debugging=(\\d+)", 1).cast("long").alias("debugging"))
    return mix


@query("D17_first_seen_types", f"WITH {TELEMETRY_SQL}, {EPISODES_SQL}, f AS (SELECT session_id, episode, event_type, min(struct_pack(a := created_at, b := ordinal)) AS first_at FROM eps GROUP BY ALL) SELECT session_id, episode::BIGINT AS episode, string_agg(event_type, ',' ORDER BY first_at) AS types FROM f GROUP BY 1, 2")
def d17(spark, sf):
    e = events.materialise_episodes(events.episodes_of(telemetry(spark, sf), gap_seconds=86400, cap=2))
    return e.select("session_id", "episode", F.array_join("event_types", ",").alias("types"))


@query("D18_episode_summaries", f"WITH {TELEMETRY_SQL}, {EPISODES_SQL}, x AS (SELECT session_id, episode, created_at, ordinal, concat_ws(' | ', message, command, tool_name, file_path) AS s FROM eps) SELECT session_id, episode::BIGINT AS episode, left(coalesce(string_agg(s, chr(10) ORDER BY created_at, ordinal) FILTER (s <> ''), ''), 3000) AS summary FROM x GROUP BY 1, 2")
def d18(spark, sf):
    e = events.materialise_episodes(events.episodes_of(telemetry(spark, sf), gap_seconds=86400, cap=2))
    return e.select("session_id", "episode", "summary")


# --- E: ranking signals -------------------------------------------------------------------


@query("E06_fnv1a", "SELECT s_suppkey, list_reduce(list_transform(string_split(s_name, ''), lambda c: ascii(c)::BIGINT), lambda h, x: (xor(h, x) * 16777619) & 4294967295, 2166136261::BIGINT) AS h FROM supplier")
def e06(spark, sf):
    return read(spark, sf, "supplier").select("s_suppkey", text.fnv1a(F.col("s_name")).alias("h"))


@query("E13_collection_names", f"SELECT vec_id AS id, {COLLECTION_SQL} AS collection FROM embeddings WHERE label >= 0")
def e13(spark, sf):
    return _typed_vectors(spark, sf).select("id", retrieval.collection_name(F.col("memory_type")).alias("collection"))


@query("E17_authority_boost", f"WITH {MEMORIES_SQL} SELECT id, (CASE authority WHEN 'repository' THEN 0.18 WHEN 'test_verified' THEN 0.15 WHEN 'tool_verified' THEN 0.12 WHEN 'user_confirmed' THEN 0.10 WHEN 'session_derived' THEN 0.04 ELSE 0 END)::DOUBLE AS authority_boost, (CASE verification WHEN 'verified' THEN 0.10 WHEN 'inferred' THEN 0.02 ELSE 0 END)::DOUBLE AS verification_boost FROM mem")
def e17(spark, sf):
    return memories(spark, sf).select("id", lookup(F.col("authority"), ranking.AUTHORITY_BOOST, 0.0).alias("authority_boost"), lookup(F.col("verification"), ranking.VERIFICATION_BOOST, 0.0).alias("verification_boost"))


@query("E21_continuation_boost", f"WITH {MEMORIES_SQL}, r AS (SELECT *, (1767225600 - created_s) / 86400.0 <= 30 AS recent FROM mem) SELECT id, (CASE WHEN superseded_by IS NOT NULL THEN -0.20 WHEN memory_type IN ('task', 'decision', 'constraint', 'open_question', 'fix') THEN CASE WHEN recent THEN 0.30 ELSE 0.15 END WHEN recent THEN 0.05 ELSE 0 END)::DOUBLE AS boost FROM r")
def e21(spark, sf):
    m = memories(spark, sf)
    return m.select("id", ranking.continuation_boost(F.col("superseded_by").isNotNull(), F.col("memory_type"), ranking.recency(F.col("created_at"), F.lit(NOW))).alias("boost"))


@query("E23_source_class", f"WITH {MEMORIES_SQL}, t AS (SELECT id, memory_type, CASE id % 5 WHEN 0 THEN 'Session summary of ' WHEN 1 THEN 'Episode 3 ' WHEN 2 THEN 'A Session Reflection ' WHEN 3 THEN 'x: debugging - ' ELSE '' END || title AS title FROM mem) SELECT id, CASE WHEN contains(lower(title), 'session reflection') THEN 'reflection' WHEN memory_type = 'summary' AND (starts_with(lower(title), 'session summary') OR starts_with(lower(title), 'episode ') OR regexp_matches(lower(title), ': (debugging|conversation|implementation) -')) THEN 'session_summary' ELSE memory_type END AS source_class FROM t")
def e23(spark, sf):
    lead = F.element_at(F.array(*map(F.lit, ("Session summary of ", "Episode 3 ", "A Session Reflection ", "x: debugging - ", ""))), (F.col("id") % 5 + 1).cast("int"))
    return memories(spark, sf).select("id", ranking.source_class(F.col("memory_type"), F.concat(lead, "title")).alias("source_class"))


@query("E24_ranking_role", f"WITH {MEMORIES_SQL} SELECT id, CASE memory_type WHEN 'decision' THEN 'durable_decision' WHEN 'task' THEN 'active_task' WHEN 'constraint' THEN 'constraint_guardrail' WHEN 'fact' THEN 'project_fact' WHEN 'implementation_detail' THEN 'implementation_note' WHEN 'bug' THEN 'known_bug' WHEN 'fix' THEN 'verified_fix' WHEN 'open_question' THEN 'open_question' WHEN 'summary' THEN 'summary_fallback' ELSE 'general_memory' END AS role FROM mem")
def e24(spark, sf):
    return memories(spark, sf).select("id", ranking.ranking_role(F.col("memory_type"), F.col("memory_type")).alias("role"))


@query("E25_source_prior", f"WITH {MEMORIES_SQL} SELECT id, (CASE memory_type WHEN 'decision' THEN 0.16 WHEN 'fact' THEN 0.16 WHEN 'implementation_detail' THEN 0.16 WHEN 'constraint' THEN 0.16 WHEN 'fix' THEN 0.16 WHEN 'task' THEN 0.08 WHEN 'open_question' THEN -0.04 WHEN 'summary' THEN -0.14 ELSE 0 END)::DOUBLE AS prior FROM mem")
def e25(spark, sf):
    return memories(spark, sf).select("id", ranking.source_prior(F.col("memory_type"), F.col("memory_type"), ranking.Request(intent="repository_only")).alias("prior"))


@query("E18_conflict_penalty", f"WITH {MEMORIES_SQL}, a AS (SELECT id, conflicts, governance, community_score FROM mem) SELECT id, round(-least(0.24, conflicts * 0.08) + CASE governance WHEN 'pinned' THEN 0.20 WHEN 'rejected' THEN -0.80 ELSE 0 END + community_score * 0.15, 6)::DOUBLE AS score FROM a")
def e18(spark, sf):
    none = F.lit(None).cast("double")
    m = memories(spark, sf).withColumns({"lexical_score": none, "semantic_score": none, "graph_proximity": none, "importance": none, "confidence": none, "authority": F.lit(None).cast("string"), "verification": F.lit(None).cast("string"), "memory_type": F.lit("other"), "title": F.lit(""), "superseded_by": F.lit(None).cast("string"), "created_at": F.lit(NOW)})
    fused = ranking.fuse(m, ranking.Request(intent="repository_only", now=NOW))
    return fused.select("id", six(F.col("final_score") - 0.08).alias("score"))


@query("E30_clamped", "SELECT event_id, CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 0 ELSE least(1.0, greatest(0.0, value / 60 - 0.2)) END::DOUBLE AS clamped FROM events")
def e30(spark, sf):
    return read(spark, sf, "events").select("event_id", text.clamp01(F.col("value").cast("double") / 60 - 0.2).alias("clamped"))


@query("E32_provenance_dedupe", f"WITH {PROOF_SQL}, k AS (SELECT memory_id, coalesce(string_agg(session_id || ':' || session_event_id, '|' ORDER BY session_id || ':' || session_event_id), '') AS key FROM pm LEFT JOIN prov USING (memory_id) GROUP BY 1) SELECT memory_id AS id FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY memory_id % 7 DESC, memory_id) = 1")
def e32(spark, sf):
    p = _provenance(spark, sf).groupBy("memory_id").agg(F.collect_list(F.concat_ws(":", "session_id", "session_event_id")).alias("provenance"))
    hits = _proof_memories(spark, sf).select("memory_id").join(p, "memory_id", "left").select(F.col("memory_id").alias("id"), F.coalesce("provenance", F.array().cast("array<string>")).alias("provenance"), (F.col("memory_id") % 7).alias("final_score"))
    return ranking.dedupe_by_provenance(hits).select("id")


@query("E33_disclosure", f"WITH {MEMORIES_SQL}, r AS (SELECT id, row_number() OVER (ORDER BY importance DESC, created_s DESC, id) AS rank FROM mem) SELECT id, rank::INT AS rank, CASE WHEN rank <= 5 THEN 'overview' WHEN rank <= 12 THEN 'related' ELSE 'full' END AS level FROM r WHERE rank <= 20")
def e33(spark, sf):
    return ranking.disclose(memories(spark, sf).withColumn("final_score", F.col("importance")), 20).select("id", "rank", "level")


POINTS_SQL = "CASE verification WHEN 'verified' THEN 40 WHEN 'inferred' THEN 10 ELSE -6 END + CASE authority WHEN 'repository' THEN 30 WHEN 'test_verified' THEN 28 WHEN 'tool_verified' THEN 24 WHEN 'user_confirmed' THEN 18 WHEN 'session_derived' THEN 5 ELSE -12 END + CASE memory_type WHEN 'constraint' THEN 24 WHEN 'decision' THEN 22 WHEN 'fix' THEN 20 WHEN 'fact' THEN 20 WHEN 'task' THEN 18 WHEN 'open_question' THEN 18 WHEN 'bug' THEN 16 WHEN 'implementation_detail' THEN -4 ELSE -18 END + round(importance * 100)::INT"


@query("E45_hit_priority", f"WITH {MEMORIES_SQL} SELECT id, ({POINTS_SQL})::INT AS priority FROM mem")
def e45(spark, sf):
    from loomspan.plans.search import hit_priority

    return memories(spark, sf).withColumn("final_score", F.col("importance")).select("id", hit_priority("what is open").alias("priority"))


@query("E43_context_hits", f"WITH {MEMORIES_SQL} SELECT id FROM mem WHERE memory_type NOT IN ('summary', 'implementation_detail') ORDER BY ({POINTS_SQL}) DESC, importance DESC, id LIMIT 12")
def e43(spark, sf):
    from loomspan.plans.search import best_hits

    m = memories(spark, sf).withColumn("final_score", F.col("importance"))
    return best_hits(m.unionByName(m.withColumn("final_score", F.col("final_score") - 0.3)), "what is open").select("id")


@query("E46_bag_cosine", "WITH a AS (SELECT item_id AS id, t, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM benchmark) GROUP BY 1, 2), b AS (SELECT doc_id AS id, t, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)) GROUP BY 1, 2), d AS (SELECT a.id, sum(a.n * b.n) AS dot, count(*) AS k FROM a JOIN b ON a.id = b.id AND a.t = b.t GROUP BY 1), x AS (SELECT id, sqrt(sum(n * n)) AS v FROM a GROUP BY 1), y AS (SELECT id, sqrt(sum(n * n)) AS v FROM b GROUP BY 1) SELECT coalesce(x.id, y.id) AS id, round(coalesce(dot / (x.v * y.v), 0), 6)::DOUBLE AS cosine, coalesce(k, 0) AS overlap FROM x FULL JOIN y ON x.id = y.id LEFT JOIN d ON d.id = coalesce(x.id, y.id)")
def e46(spark, sf):
    b = read(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text").join(b.select("id"), "id", "left_semi")
    return retrieval.bag_cosine(b, d, "id", "text")


@query("E12_quantised", "SELECT vec_id, list_sum(list_transform(embedding, lambda x: round((greatest(-1.0, least(1.0, x::DOUBLE)) + 1) / 2 * 15)))::BIGINT AS total FROM embeddings")
def e12(spark, sf):
    q = retrieval.quantise(F.col("embedding"), 4)
    return read(spark, sf, "embeddings").select("vec_id", F.aggregate(q, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


# --- F, G: order, upserts ---------------------------------------------------------------------


@query("F03_latest_row", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def f03(spark, sf):
    return read(spark, sf, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1).select("o_orderkey")


@query("F08_hub_types", f"WITH {GRAPH_SQL} SELECT id, degree, node_type AS hub FROM degree ORDER BY degree DESC, id LIMIT 5")
def f08(spark, sf):
    return graph.hubs(*order_graph(spark, sf), 5).select("id", "degree", F.col("node_type").alias("hub"))


@query("F10_degree_order", f"WITH {GRAPH_SQL} SELECT id, row_number() OVER (ORDER BY degree DESC, node_type, label) - 1 AS n FROM degree")
def f10(spark, sf):
    n, e = order_graph(spark, sf)
    d = n.join(graph.degrees(n, e).select("id", "degree"), "id")
    return relational.numbered(d, [F.desc("degree"), F.asc("node_type"), F.asc("label")]).select("id", "n")


@query("F13_newest_nulls_last", "SELECT l_orderkey, l_linenumber FROM (SELECT *, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_shipdate END AS d FROM lineitem) ORDER BY d DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 40")
def f13(spark, sf):
    d = F.when(F.col("l_linenumber") == 3, None).otherwise(F.col("l_shipdate"))
    return read(spark, sf, "lineitem").withColumn("d", d).orderBy(F.desc_nulls_last("d"), "l_orderkey", "l_linenumber").limit(40).select("l_orderkey", "l_linenumber")


@query("F05_claim_pages", f"WITH {MEMORIES_SQL}, o AS (SELECT claim_id, created_s FROM mem ORDER BY created_s DESC, claim_id DESC) SELECT claim_id FROM o WHERE (created_s, claim_id) < (1767225600 - 36000 * 20, '20') LIMIT 26")
def f05(spark, sf):
    from datetime import UTC, datetime

    at = datetime.fromtimestamp(1767225600 - 36000 * 20, UTC)
    return relational.keyset_page(memories(spark, sf), "created_at", "claim_id", (at, "20"), 25).select("claim_id")


@query("G20_insert_or_ignore", "SELECT c_custkey AS id, 1 AS v FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_custkey % 3 = 0")
def g20(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return relational.insert_or_ignore(c.where("id % 3 <> 0").withColumn("v", F.lit(1)), c.withColumn("v", F.lit(2)), ["id"])


@query("G07_json_merge", f"WITH {MEMORIES_SQL} SELECT id, 'x' AS a, CASE WHEN id % 2 = 0 THEN 'z' ELSE 'y' END AS b, CASE WHEN id % 2 = 0 THEN 'w' END AS c FROM mem")
def g07(spark, sf):
    own = F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("y"))
    patch = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("b"), F.lit("z"), F.lit("c"), F.lit("w"))).otherwise(F.create_map().cast("map<string,string>"))
    m = relational.merge_maps(own, patch)
    return memories(spark, sf).select("id", *[m[k].alias(k) for k in "abc"])


@query("G10_last_nodes", f"WITH {GRAPH_SQL}, u AS (SELECT id, label, 1 AS v FROM nodes UNION ALL SELECT id, label || ' again', 2 FROM nodes WHERE node_type = 'nation') SELECT id, arg_max(label, v) AS label FROM u GROUP BY 1")
def g10(spark, sf):
    n, _ = order_graph(spark, sf)
    both = n.withColumn("v", F.lit(1)).unionByName(n.where("node_type = 'nation'").withColumns({"label": F.concat("label", F.lit(" again")), "v": F.lit(2)}))
    return graph.last_nodes(both, ("v",)).select("id", "label")


@query("G17_accepted_paths", f"WITH {PATHS_SQL} SELECT path, CASE WHEN page_id % 4 = 0 THEN 'missing' ELSE 'accepted' END AS state FROM pth")
def g17(spark, sf):
    p = _paths(spark, sf)
    sent = p.where("page_id % 4 <> 0").select("path")
    return p.select("path").join(sent, "path", "left_anti").select("path", F.lit("missing").alias("state")).unionByName(sent.select("path", F.lit("accepted").alias("state")))


@query("G19_governance", f"WITH {MEMORIES_SQL} SELECT claim_id, CASE id % 4 WHEN 0 THEN 'archived' WHEN 1 THEN 'pinned' ELSE governance END AS governance FROM mem")
def g19(spark, sf):
    m = memories(spark, sf).select("id", "claim_id", "governance")
    d = m.where("id % 4 in (0, 1)").select("claim_id", F.explode(F.when(F.col("id") % 4 == 0, F.array(F.struct(F.lit("pinned").alias("state"), F.lit(1).alias("decided_at")), F.struct(F.lit("archived").alias("state"), F.lit(2).alias("decided_at")))).otherwise(F.array(F.struct(F.lit("pinned").alias("state"), F.lit(1).alias("decided_at"))))).alias("x")).select("claim_id", "x.*")
    return claims.govern(m, d)[0].select("claim_id", "governance")


@query("G23_project_upsert", "SELECT n_nationkey AS id, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN 'old' END, 'new') AS branch FROM nation")
def g23(spark, sf):
    stored = read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, "old").alias("branch"))
    fresh = stored.select("id", F.lit("new").alias("branch"))
    return relational.set_once(relational.insert_or_ignore(stored, fresh, ["id"]), fresh, "id", "branch")


# --- H, I: derivation ------------------------------------------------------------------------


@query("H02_event_types", "WITH n AS (SELECT event_id, (['User', 'assistant-message', ' tool use', 'function_call_output', 'shell', 'error', 'thinking', 'odd'])[CAST(event_id % 8 + 1 AS INT)] AS raw FROM events) SELECT event_id, (['prompt', 'response', 'tool_call', 'tool_result', 'command', 'error', 'reasoning', 'annotation'])[CAST(event_id % 8 + 1 AS INT)] AS event_type FROM n")
def h02(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ("User", "assistant-message", " tool use", "function_call_output", "shell", "error", "thinking", "odd"))), (F.col("event_id") % 8 + 1).cast("int"))
    return read(spark, sf, "events").select("event_id", events.event_type(raw).alias("event_type"))


@query("H04_stable_ids", "SELECT doc_id, left(sha256(text), 32) AS id FROM documents")
def h04(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.stable_id(F.col("text")).alias("id"))


PROOF_TYPES_SQL = "CASE WHEN event_type IN ('prompt', 'annotation') THEN 'user_confirmation' WHEN event_type IN ('tool_result', 'command', 'file_change') THEN 'tool_result' WHEN event_type IN ('test_result', 'error') THEN 'test_result' ELSE 'session_event' END"


@query("H10_proof_types", f"WITH {TELEMETRY_SQL} SELECT event_id, {PROOF_TYPES_SQL} AS proof_type FROM ev")
def h10(spark, sf):
    return telemetry(spark, sf).select("event_id", claims.proof_type(F.col("event_type")).alias("proof_type"))


@query("H11_authority", f"WITH {TELEMETRY_SQL} SELECT event_id, CASE {PROOF_TYPES_SQL} WHEN 'user_confirmation' THEN 'user_confirmed' WHEN 'tool_result' THEN 'tool_verified' WHEN 'test_result' THEN 'test_verified' ELSE 'session_derived' END AS authority FROM ev")
def h11(spark, sf):
    return telemetry(spark, sf).select("event_id", claims.authority(F.col("event_type")).alias("authority"))


@query("H12_verification", f"WITH {TELEMETRY_SQL} SELECT event_id, CASE WHEN ordinal % 9 = 0 THEN 'unverified' ELSE CASE {PROOF_TYPES_SQL} WHEN 'user_confirmation' THEN 'user_confirmed' WHEN 'session_event' THEN 'inferred' ELSE 'verified' END END AS verification FROM ev")
def h12(spark, sf):
    said = F.when(F.col("ordinal") % 9 == 0, "It might be so").otherwise("It is so")
    return telemetry(spark, sf).select("event_id", claims.verification(said, F.col("event_type")).alias("verification"))


@query("H08_segment_rows", f"WITH {SEGMENTS_SQL} SELECT doc_id, p::INT AS place, s AS segment FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS p, s FROM seg)")
def h08_rows(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.posexplode(claims.segments(F.col("text"))).alias("place", "segment"))


@query("H09_claim_type_rows", f"WITH {SEGMENTS_SQL} SELECT doc_id, s AS segment, coalesce({TYPE_SQL}, 'none') AS claim_type, count(*) AS n FROM seg GROUP BY ALL")
def h09_rows(spark, sf):
    s = read(spark, sf, "documents").select("doc_id", F.explode(claims.segments(F.col("text"))).alias("segment"))
    kind = claims.claim_type(F.col("segment"), F.lit(None).cast("string"), F.lit(None).cast("int"))
    return s.withColumn("claim_type", F.coalesce(kind, F.lit("none"))).groupBy("doc_id", "segment", "claim_type").agg(F.count("*").alias("n"))


@query("H18_atomic_claim_rows", f"""WITH {TELEMETRY_SQL}, s AS (SELECT event_id, event_type, exit_code, unnest(list_filter(list_transform(string_split(concat_ws(' | ', message, command, tool_name, file_path), '|'), lambda y: trim(y)), lambda y: octet_length(encode(y)) >= 12)) AS s FROM ev)
  SELECT event_id, s AS segment, CASE WHEN event_type = 'error' OR exit_code <> 0 OR regexp_matches(lower(s), 'failed|error|exception|bug:') THEN 'bug' ELSE 'implementation_detail' END AS claim_type
  FROM s WHERE event_type = 'error' OR exit_code <> 0 OR regexp_matches(lower(s), 'failed|error|exception|bug:') OR event_type IN ('command', 'tool_call', 'tool_result', 'file_change')""")
def h18_rows(spark, sf):
    e = telemetry(spark, sf).select("event_id", "event_type", "exit_code", F.explode(claims.segments(events.event_text())).alias("segment"))
    kind = claims.claim_type(F.col("segment"), F.col("event_type"), F.col("exit_code"))
    return e.select("event_id", "segment", kind.alias("claim_type")).where("claim_type is not null")


@query("H23_session_edge_rows", f"""WITH {TELEMETRY_SQL}, {SIGNALS_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY CAST(session_id AS INT) % 6 ORDER BY session_id) AS n FROM sig),
  x AS (SELECT least(a.session_id, b.session_id) AS source, greatest(a.session_id, b.session_id) AS target, len(list_intersect(a.files, b.files)) AS f FROM s a JOIN s b ON CAST(a.session_id AS INT) % 6 = CAST(b.session_id AS INT) % 6 AND b.n < a.n AND b.n >= a.n - 20)
  SELECT source, target, CASE WHEN CAST(source AS INT) % 2 = CAST(target AS INT) % 2 THEN 'same_branch' ELSE 'related_to' END AS relation FROM x WHERE CAST(source AS INT) % 2 = CAST(target AS INT) % 2""")
def h23(spark, sf):
    number = F.col("session_id").cast("int")
    s = events.session_signals(telemetry(spark, sf)).withColumns({"project_id": F.concat(F.lit("p"), (number % 6).cast("string")), "branch": F.concat(F.lit("b"), (number % 2).cast("string")), "ended_at": F.lit(0)})
    return events.session_edges(s).where("relation = 'same_branch'").select("source", "target", "relation")


@query("I07_current_truth", f"WITH {MEMORIES_SQL} SELECT id FROM mem WHERE admitted AND superseded_by IS NULL AND verification <> 'contradicted' AND governance NOT IN ('archived', 'rejected') AND (verification IN ('verified', 'user_confirmed') OR authority IN ('repository', 'tool_verified', 'test_verified', 'user_confirmed'))")
def i07(spark, sf):
    m = memories(spark, sf)
    return m.where(claims.is_current()).where(claims.is_truth(F.col("verification"), F.col("authority"))).select("id")


@query("I05_state_updates", f"WITH {MEMORIES_SQL}, e AS (SELECT claim_id, CAST(id - 3 AS VARCHAR) AS prior FROM mem WHERE id % 5 = 0) SELECT m.claim_id, coalesce(superseded_by, e.claim_id) AS superseded_by, CASE WHEN m.id % 7 = 0 THEN 'contradicted' ELSE verification END AS verification FROM mem m LEFT JOIN e ON e.prior = m.claim_id")
def i05(spark, sf):
    m = memories(spark, sf).select("id", "claim_id", "superseded_by", "verification")
    by = m.where("id % 5 = 0").select("claim_id", (F.col("id") - 3).cast("string").alias("prior_claim_id"), F.lit("supersedes").alias("relation"), F.lit(None).cast("string").alias("loser"))
    lost = m.where("id % 7 = 0").select("claim_id", F.lit("none").alias("prior_claim_id"), F.lit("contradicts").alias("relation"), F.col("claim_id").alias("loser"))
    return reconcile.apply_edges(m, by.unionByName(lost)).select("claim_id", "superseded_by", "verification")


# --- J, K: graphs ------------------------------------------------------------------------------


@query("J03_command_labels", f"WITH {TELEMETRY_SQL} SELECT event_id, left(lower(array_to_string(list_filter(regexp_split_to_array(trim(command), '\\s+'), lambda x: x <> '')[1:3], ' ')), 60) AS label FROM ev WHERE command IS NOT NULL")
def j03(spark, sf):
    return telemetry(spark, sf).where("command is not null").select("event_id", graph.command_label(F.col("command")).alias("label"))


@query("J04_episode_edges", f"WITH {TELEMETRY_SQL}, {EPISODES_SQL}, ep AS (SELECT session_id, episode, any_value(t) AS t FROM eps GROUP BY 1, 2), l AS (SELECT *, lead(episode) OVER w AS nxt, lead(t) OVER w AS nt FROM ep WINDOW w AS (PARTITION BY session_id ORDER BY episode)) SELECT 'session:' || session_id AS source, 'episode:' || session_id || ':' || episode AS target, 'contains' AS relation FROM ep UNION ALL SELECT 'episode:' || session_id || ':' || episode, 'episode:' || session_id || ':' || nxt, 'related_to' FROM l WHERE nxt IS NOT NULL UNION ALL SELECT 'episode:' || session_id || ':' || nxt, 'episode:' || session_id || ':' || episode, 'caused_by' FROM l WHERE (t = 'implementation' AND nt = 'debugging') OR (t = 'debugging' AND nt = 'implementation')")
def j04(spark, sf):
    e = events.materialise_episodes(events.episodes_of(telemetry(spark, sf), gap_seconds=86400, cap=2))
    return graph.episode_graph(e)[1].select("source", "target", "relation")


def _graph_memories(spark, sf):
    m = memories(spark, sf)
    return m.select(F.col("id").alias("memory_id"), F.get("session_ids", F.lit(0)).alias("session_id"), (F.col("id") % 4).alias("episode"), "memory_type", "title", "content")


@query("J06_memory_edges", f"WITH {MEMORIES_SQL} SELECT 'session:' || session_ids[1] AS source, 'memory:' || id AS target, CASE memory_type WHEN 'risk' THEN 'error' ELSE memory_type END AS node_type FROM mem")
def j06(spark, sf):
    nodes, edges = graph.memory_graph(_graph_memories(spark, sf))
    return edges.join(nodes.select(F.col("id").alias("target"), "node_type"), "target").select("source", "target", "node_type")


@query("J11_companions", f"WITH {MEMORIES_SQL} SELECT 'memory:' || a.id AS source, 'memory:' || b.id AS target FROM mem a JOIN mem b ON a.session_ids[1] = b.session_ids[1] AND a.id % 4 = b.id % 4 AND a.memory_type = 'summary' AND b.memory_type IN ('bug', 'implementation_detail')")
def j11(spark, sf):
    return graph.companion_edges(_graph_memories(spark, sf)).select("source", "target")


@query("J12_relationship_policies", f"WITH {MEMORIES_SQL} SELECT a.id, CASE WHEN a.session_ids[1] IS NOT NULL AND a.id % 3 <> 0 AND (a.id + 20) % 3 <> 0 THEN CASE WHEN a.id % 4 = (a.id + 20) % 4 THEN 'same_episode_only' ELSE 'skip' END WHEN a.memory_type = 'bug' OR b.memory_type = 'bug' THEN 'strong_only' ELSE 'allow_ambiguous' END AS policy FROM mem a JOIN mem b ON b.id = a.id + 20")
def j12(spark, sf):
    m = _graph_memories(spark, sf).select("memory_id", F.struct(F.when(F.col("memory_id") % 3 != 0, F.col("session_id")).alias("session_id"), "episode", "memory_type").alias("p"))
    both = m.join(m.select((F.col("memory_id") - 20).alias("memory_id"), F.col("p").alias("q")), "memory_id")
    return both.select(F.col("memory_id").alias("id"), graph.relationship_policy("p", "q").alias("policy"))


@query("J07_continuity_edges", f"""WITH {TELEMETRY_SQL}, s AS (SELECT session_id, count(DISTINCT trim(file_path)) FILTER (trim(file_path) <> '') AS n, row_number() OVER (PARTITION BY CAST(session_id AS INT) % 5 ORDER BY session_id) AS r FROM ev GROUP BY 1)
  SELECT 'session:' || b.session_id AS source, 'session:' || a.session_id AS target, a.n::INT AS shared_files FROM s a JOIN s b ON CAST(a.session_id AS INT) % 5 = CAST(b.session_id AS INT) % 5 AND b.r < a.r AND b.r >= a.r - 20 WHERE a.n > 0""")
def j07(spark, sf):
    s = events.session_signals(telemetry(spark, sf)).withColumns({"project_id": F.col("session_id").cast("int") % 5, "ended_at": F.lit(0)})
    return graph.continuity_edges(s).select("source", "target", "shared_files")


@query("J32_distinctive_tokens", "SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{3,}')), lambda t: length(t) >= 6 OR regexp_matches(t, '[0-9]')))::INT AS n FROM documents")
def j32(spark, sf):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]{3,})"), F.lit(1)))
    return read(spark, sf, "documents").select("doc_id", text.distinctive(words).alias("n"))


@query("J09_first_nodes", f"WITH {TELEMETRY_SQL}, t AS (SELECT 'tool:' || tool_name AS id, event_id, created_at, ordinal FROM ev WHERE event_type NOT IN ('file_change', 'test_result') AND tool_name IS NOT NULL) SELECT id, arg_min(event_id, struct_pack(a := created_at, b := ordinal)) AS source_id FROM t GROUP BY 1")
def j09(spark, sf):
    return graph.structural_graph(telemetry(spark, sf))[0].where("node_type = 'tool'").select("id", "source_id")


@query("K08_component_labels", f"WITH RECURSIVE {TELEMETRY_SQL}, e AS (SELECT DISTINCT 's' || session_id AS a, file_path AS b FROM ev WHERE file_path IS NOT NULL), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT DISTINCT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM reach r JOIN l ON l.a = r.seen) SELECT node, min(seen) AS component FROM reach GROUP BY 1")
def k08_labels(spark, sf):
    e = telemetry(spark, sf).where("file_path is not null").select(F.concat(F.lit("s"), "session_id").alias("a"), F.col("file_path").alias("b"))
    return components.components(e.distinct())


@query("K02_path_is_path", f"WITH {GRAPH_SQL} SELECT 3 AS hops, 3 AS edges_found")
def k02_path(spark, sf):
    n, e = order_graph(spark, sf)
    path = traverse.shortest_path(e, "region:0", n.where("node_type = 'order'").join(e.select(F.col("target").alias("id"), F.col("source").alias("c")), "id").join(e.select(F.col("source").alias("c"), F.col("target").alias("nation")), "c").join(e.select(F.col("source").alias("nation"), F.col("target").alias("region")), "nation").where("region = 'region:0'").agg(F.min("id")).first()[0])
    return path.agg(F.max("pos").alias("hops")).withColumn("edges_found", F.lit(traverse.path_edges(e, path).count()).cast("int"))


@query("K04_incident_edges", f"WITH {GRAPH_SQL} SELECT source, target FROM edges WHERE source IN (SELECT id FROM nodes WHERE node_type = 'nation') OR target IN (SELECT id FROM nodes WHERE node_type = 'nation')")
def k04(spark, sf):
    n, e = order_graph(spark, sf)
    return traverse.community_nodes(n.select("id", F.col("node_type").alias("community")), n.drop("community"), e, "nation")[1].select("source", "target")


@query("K16_adjacency", f"WITH {GRAPH_SQL} SELECT a, b, sum(w)::DOUBLE AS w FROM (SELECT source AS a, target AS b, weight AS w FROM edges UNION ALL SELECT target, source, weight FROM edges) GROUP BY 1, 2")
def k16(spark, sf):
    return graph.both_ways(order_graph(spark, sf)[1], "weight").groupBy("a", "b").agg(F.sum("w").alias("w"))


@query("K19_neighbour_index", f"WITH {GRAPH_SQL}, b AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges) SELECT id, hop::INT AS hop FROM (SELECT 'region:1' AS id, 0 AS hop UNION ALL SELECT b, 1 FROM b WHERE a = 'region:1')")
def k19(spark, sf):
    return traverse.neighbours(order_graph(spark, sf)[1], spark.createDataFrame([("region:1",)], "id string"), 1)


# --- L, M, N: context, scalars, queues --------------------------------------------------------------

PACK_SQL = "items AS (SELECT doc_id AS item_id, doc_id % 6 AS request_id, CASE doc_id % 5 WHEN 0 THEN 'repository' WHEN 1 THEN 'session_graph' WHEN 2 THEN 'conflict' ELSE 'memory' END AS source_class, (['fact','decision','task','bug'])[CAST(doc_id % 4 + 1 AS INT)] AS memory_type, CASE WHEN doc_id % 3 = 0 THEN 'verified' WHEN doc_id % 3 = 1 THEN 'contradicted' ELSE 'inferred' END AS verification FROM documents)"


def _pack_items(spark, sf):
    i = F.col("doc_id")
    of = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (i % n + 1).cast("int"))
    handle = F.struct(F.concat(F.lit("ref"), (i % 11).cast("string")).alias("source_ref"), F.lit("s").alias("session_id"), (i % 11).cast("string").alias("session_event_id"), F.lit("session_event").alias("proof_type"), i.cast("string").alias("excerpt"))
    return read(spark, sf, "documents").select(
        i.alias("item_id"), (i % 6).alias("request_id"), of(("repository", "session_graph", "conflict", "memory", "memory"), 5).alias("source_class"), of(("fact", "decision", "task", "bug"), 4).alias("memory_type"),
        of(("verified", "contradicted", "inferred"), 3).alias("verification"), F.lit(None).cast("string").alias("authority"), F.array(handle).alias("proof_handles"), F.array(F.struct(F.lit("s").alias("session_id"), (i % 11).cast("string").alias("session_event_id"), i.cast("string").alias("excerpt"))).alias("sources"),
    )


def _pack(spark, sf):
    items = _pack_items(spark, sf)
    return context.context_pack(items, items.select("request_id", "item_id", F.col("item_id").alias("place")), context.verified_truth())


def _section_sql(when: str) -> str:
    return f"WITH {PACK_SQL} SELECT r.request_id, coalesce(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) FILTER ({when}), '') AS ids FROM items r GROUP BY 1"


@query("L15_truth_section", _section_sql("source_class = 'repository' OR (source_class = 'memory' AND verification = 'verified')"))
def l15(spark, sf):
    return _pack(spark, sf).select("request_id", F.array_join("current_truth", ",").alias("ids"))


@query("L16_conflict_section", _section_sql("source_class = 'conflict' OR verification = 'contradicted'"))
def l16(spark, sf):
    return _pack(spark, sf).select("request_id", F.array_join("conflicts", ",").alias("ids"))


@query("L04_section_routing", _section_sql("source_class = 'memory' AND memory_type = 'decision'"))
def l04(spark, sf):
    return _pack(spark, sf).select("request_id", F.array_join("recent_decisions", ",").alias("ids"))


@query("D21_unique_proofs", f"WITH {PACK_SQL}, u AS (SELECT request_id, 'ref' || (item_id % 11) AS ref, max(item_id) AS last FROM items GROUP BY 1, 2) SELECT request_id, string_agg(ref || '=' || last, ',' ORDER BY ref) AS proofs, count(*) AS sources FROM u GROUP BY 1")
def d21(spark, sf):
    p = _pack(spark, sf)
    return p.select("request_id", F.array_join(F.transform("proof_handles", lambda x: F.concat(x["source_ref"], F.lit("="), x["excerpt"])), ",").alias("proofs"), F.size("sources").cast("long").alias("sources"))


@query("L05_unknowns", f"WITH {PACK_SQL} SELECT request_id, CASE WHEN bool_or(source_class = 'repository') THEN 0 ELSE 1 END + CASE WHEN bool_or(source_class = 'conflict' OR verification = 'contradicted') THEN 1 ELSE 0 END AS unknowns FROM items GROUP BY 1")
def l05(spark, sf):
    return context.advice(_pack_items(spark, sf), "repository_only").select("request_id", F.size("unknowns").alias("unknowns"))


@query("L08_cover_weights", f"WITH {MEMORIES_SQL} SELECT id, (CASE authority WHEN 'repository' THEN 1.0 WHEN 'user_confirmed' THEN 1.0 WHEN 'tool_verified' THEN 0.95 WHEN 'test_verified' THEN 0.95 WHEN 'session_derived' THEN 0.55 ELSE 0 END * greatest(0.25, least(1.0, (id % 4) / 2.0)) * CASE WHEN id % 6 = 0 THEN 0.35 ELSE 1 END)::DOUBLE AS weight FROM mem")
def l08(spark, sf):
    m = memories(spark, sf).withColumns({"proofs": F.col("id") % 4, "valid_to": F.when(F.col("id") % 6 == 0, "2025-01-01")})
    return m.select("id", (context.authority_factor() * context.proof_density() * context.freshness()).alias("weight"))


@query("M01_trims", "SELECT doc_id, lower(trim(text)) AS t, starts_with(lower(text), 'the') AS s, ends_with(trim(text), '.') AS e FROM documents")
def m01(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.lower(F.trim("text")).alias("t"), F.lower("text").startswith("the").alias("s"), F.trim("text").endswith(".").alias("e"))


@query("M02_truncate", "SELECT doc_id, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS cut FROM documents")
def m02(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.clip(F.col("text"), 50, "...").alias("cut"))


@query("M03_tokens", "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+'))::INT AS n FROM documents")
def m03(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.size(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+)"), F.lit(1))).alias("n"))


@query("M07_paths", f"WITH {PATHS_SQL} SELECT page_id, split_part(path, '/', 2) AS base, {EXT_SQL} AS ext, 'a/' || path AS clean FROM pth")
def m07(spark, sf):
    p = _paths(spark, sf)
    odd = F.concat(F.lit("./a/b/../"), F.replace(F.col("path"), F.lit("/"), F.lit("\\")))
    return p.select("page_id", text.basename(F.col("path")).alias("base"), text.extension(F.col("path")).alias("ext"), text.normal_path(odd).alias("clean"))


@query("M09_xml_text", "SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&') AS t FROM pages")
def m09(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.xml_text(F.col("html")).alias("t"))


@query("M11_age_days", "SELECT event_id, greatest(0, 1704672000 - CAST(floor(epoch(ts)) AS BIGINT)) / 86400.0::DOUBLE AS days FROM events")
def m11(spark, sf):
    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", text.age_days(F.col("ts"), F.timestamp_seconds(F.lit(1704672000))).alias("days"))


@query("M15_arrays", "SELECT doc_id, len(list_distinct(w))::INT AS d, array_to_string(list_sort(list_distinct(w))[1:3], ' ') AS first FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{4,}') AS w FROM documents)")
def m15(spark, sf):
    w = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1)))
    return read(spark, sf, "documents").select("doc_id", F.size(w).alias("d"), F.array_join(F.slice(F.sort_array(w), 1, 3), " ").alias("first"))


@query("M17_sha256", "SELECT doc_id, sha256(text) AS h FROM documents")
def m17(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))


@query("M21_base64", "SELECT doc_id, text FROM documents")
def m21(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.unbase64(F.base64(F.col("text").cast("binary"))).cast("string").alias("text"))


@query("M22_capitalised", "SELECT n_nationkey, upper(lower(n_name)[1]) || lower(n_name)[2:] AS name FROM nation")
def m22(spark, sf):
    return read(spark, sf, "nation").select("n_nationkey", text.capitalised(F.lower("n_name")).alias("name"))


@query("M08_line_of_offset", "SELECT doc_id, length(left(text, length(text) // 2)) - length(replace(left(text, length(text) // 2), chr(10), '')) + 1 AS line FROM documents")
def m08_offset(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.line_number(F.col("text"), F.expr("cast(length(text) div 2 as int)")).cast("long").alias("line"))


def _queue(spark, sf):
    i = F.col("o_orderkey")
    kinds = F.element_at(F.array(*map(F.lit, ("build_graph", "derive_session", "sync_vectors"))), (i % 3 + 1).cast("int"))
    return read(spark, sf, "orders").select(
        i.cast("string").alias("job_id"), F.concat(F.lit("k"), (i % 50).cast("string")).alias("dedupe_key"), kinds.alias("job_type"), F.concat(F.lit("p"), (i % 9).cast("string")).alias("project_id"),
        F.when(i % 4 == 0, "completed").otherwise("pending").alias("status"), (i % 100).cast("int").alias("priority"), (i % 5).cast("int").alias("attempts"),
        F.timestamp_seconds(F.lit(1767225600) + i % 1000).alias("available_at"), F.timestamp_seconds(F.lit(1767225600) + i).alias("created_at"),
    )


QUEUE_SQL = "q AS (SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderkey AS i, 'k' || (o_orderkey % 50) AS dedupe_key, (['build_graph', 'derive_session', 'sync_vectors'])[CAST(o_orderkey % 3 + 1 AS INT)] AS job_type, 'p' || (o_orderkey % 9) AS project_id, CASE WHEN o_orderkey % 4 = 0 THEN 'completed' ELSE 'pending' END AS status, (o_orderkey % 100)::INT AS priority, (o_orderkey % 5)::INT AS attempts, 1767225600 + o_orderkey % 1000 AS available_s FROM orders)"


@query("B07_active_jobs", f"WITH {QUEUE_SQL} SELECT job_id FROM q WHERE status IN ('pending', 'running')")
def b07(spark, sf):
    return relational.filtered(_queue(spark, sf), None, {"status": jobs.ACTIVE}).select("job_id")


@query("N07_enqueue", f"WITH {QUEUE_SQL} SELECT job_id, CASE WHEN status = 'pending' AND dedupe_key = 'k7' THEN least(priority, 5) ELSE priority END AS priority FROM q")
def n07(spark, sf):
    q = _queue(spark, sf)
    fresh = spark.sql("select 'k7' dedupe_key, 'sync_vectors' job_type, 5 priority, timestamp_seconds(1767225600) available_at, timestamp_seconds(1767225600) created_at")
    return jobs.enqueue(q, fresh).select("job_id", "priority")


@query("N08_claimed_jobs", f"WITH {QUEUE_SQL}, r AS (SELECT * FROM q WHERE status = 'pending' AND available_s <= 1767226100), x AS (SELECT * FROM (SELECT * FROM r WHERE job_type <> 'build_graph' ORDER BY priority, i, job_id LIMIT 20) UNION ALL SELECT * FROM (SELECT * FROM r WHERE job_type = 'build_graph' ORDER BY priority, i, job_id LIMIT 1)) SELECT job_id FROM x ORDER BY priority, i, job_id LIMIT 20")
def n08(spark, sf):
    return jobs.claim(_queue(spark, sf), F.timestamp_seconds(F.lit(1767226100)), 20).select("job_id")


@query("N09_finished_jobs", f"WITH {QUEUE_SQL} SELECT job_id, CASE WHEN i % 6 = 1 THEN 'completed' WHEN i % 6 = 2 THEN CASE WHEN attempts + 1 >= 5 THEN 'poisoned' ELSE 'pending' END ELSE status END AS status, CASE WHEN i % 6 = 2 THEN 1767230000 + least(60, 5 * 2 ** attempts)::BIGINT ELSE available_s END AS available_s FROM q")
def n09(spark, sf):
    q = _queue(spark, sf)
    i = F.col("job_id").cast("long")
    results = q.where(i % 6 == 1).select("job_id", F.lit(True).alias("ok")).unionByName(q.where(i % 6 == 2).select("job_id", F.lit(False).alias("ok")))
    return jobs.finish(q, results, F.timestamp_seconds(F.lit(1767230000))).select("job_id", "status", F.unix_timestamp("available_at").alias("available_s"))


@query("N10_collapsed_jobs", f"WITH {QUEUE_SQL} SELECT job_id, CASE WHEN job_type = 'build_graph' AND status = 'pending' AND row_number() OVER (PARTITION BY project_id, job_type, status ORDER BY i DESC, job_id DESC) > 1 THEN 'completed' ELSE status END AS status FROM q")
def n10(spark, sf):
    return jobs.collapse(_queue(spark, sf)).select("job_id", "status")


@query("N12_job_plan", "WITH p AS (SELECT c_custkey, unnest(['session_replay', 'reconcile_claims', 'derive_session', 'build_graph', 'sync_vectors']) AS job_type, unnest([20, 40, 50, 60, 70]) AS priority FROM customer) SELECT CAST(c_custkey AS VARCHAR) AS session_id, job_type, priority FROM p WHERE job_type <> 'session_replay' OR c_custkey % 3 = 0")
def n12(spark, sf):
    return jobs.plan(read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("session_id"), (F.col("c_custkey") % 3 == 0).alias("unresolved_risk"))).select("session_id", "job_type", "priority")


@query("N13_replay_states", "SELECT CAST(c_custkey AS VARCHAR) AS session_id, CASE WHEN c_custkey % 3 = 0 THEN 'failed' WHEN c_custkey % 2 = 0 THEN 'ready' ELSE 'queued' END AS status FROM customer")
def n13(spark, sf):
    r = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("session_id"), F.when(F.col("c_custkey") % 3 == 0, "failed").otherwise("queued").alias("status"))
    return jobs.replay_states(r, r.where("cast(session_id as long) % 2 = 0"))


@query("N02_session_states", "SELECT CAST(c_custkey AS VARCHAR) AS session_id, CASE WHEN c_custkey % 3 = 0 THEN 'completed' ELSE 'active' END AS status FROM customer")
def n02(spark, sf):
    from loomspan.streaming.sessions import merge_sessions

    s = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("session_id"), F.lit("active").alias("status"), F.lit(1).alias("changed_at"))
    ended = s.where("cast(session_id as long) % 3 = 0").select("session_id", F.lit("completed").alias("status"), F.lit(2).alias("changed_at"))
    return merge_sessions(s, ended).select("session_id", "status")


@query("N01_active_only", f"WITH {TELEMETRY_SQL} SELECT event_id FROM ev WHERE CAST(session_id AS INT) % 3 <> 0")
def n01(spark, sf):
    from loomspan.streaming.sessions import admitted

    e = telemetry(spark, sf)
    s = e.select("session_id").distinct().withColumn("status", F.when(F.col("session_id").cast("int") % 3 == 0, "completed").otherwise("active"))
    return admitted(e, s)[0].select("event_id")


@query("H05_class_mix", f"WITH {TELEMETRY_SQL} SELECT {CLASS_SQL} AS event_class, count(*) AS n FROM ev GROUP BY 1")
def h05_mix(spark, sf):
    return telemetry(spark, sf).groupBy(events.event_class().alias("event_class")).agg(F.count("*").alias("n"))


# --- more rows -----------------------------------------------------------------------------------------


@query("A13_image_sizes", "SELECT page_id, (page_id * 7 % 5000 + 1)::VARCHAR AS width, (page_id * 13 % 3000 + 1)::VARCHAR AS height FROM pages")
def a13(spark, sf):
    p = F.col("page_id")
    size = lambda x: F.lpad(F.hex(x), 8, "0")
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), size(p * 7 % 5000 + 1), size(p * 13 % 3000 + 1)))
    files = read(spark, sf, "pages").select(p.cast("string").alias("path"), F.lit("image").alias("kind"), png.alias("content"))
    return repository.extract(files).select(F.col("path").cast("long").alias("page_id"), F.col("facts")["width"].alias("width"), F.col("facts")["height"].alias("height"))


@query("A14_wave_headers", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '44100' ELSE '8000' END AS sample_rate, (page_id * 1000 // CASE WHEN page_id % 2 = 0 THEN 88200 ELSE 16000 END)::VARCHAR AS duration_ms FROM pages")
def a14(spark, sf):
    p = F.col("page_id")
    little = lambda x: F.concat(*[F.substring(F.lpad(F.hex(x), 8, "0"), k, 2) for k in (7, 5, 3, 1)])
    rate = F.when(p % 2 == 0, 44100).otherwise(8000).cast("long")
    wav = F.unhex(F.concat(F.lit("524946460000000057415645666D74201000000001000100"), little(rate), little(rate * 2), F.lit("0200100064617461"), little(p.cast("long"))))
    files = read(spark, sf, "pages").select(p.cast("string").alias("path"), F.lit("media").alias("kind"), wav.alias("content"))
    return repository.extract(files).select(F.col("path").cast("long").alias("page_id"), F.col("facts")["sample_rate"].alias("sample_rate"), F.col("facts")["duration_ms"].alias("duration_ms"))


@query("A12_pdf_text", "SELECT page_id, 'Page ' || page_id || ' (of many)' AS text FROM pages")
def a12(spark, sf):
    p = F.col("page_id").cast("string")
    files = read(spark, sf, "pages").select(p.alias("path"), F.lit("pdf").alias("kind"), F.concat(F.lit("%PDF-1.4 BT (Page "), p, F.lit(" \\(of many\\)) Tj ET")).cast("binary").alias("content"))
    return repository.extract(files).select(F.col("path").cast("long").alias("page_id"), "text")


@query("J24_diagnostics", "SELECT page_id, page_id % 3 <> 0 AS read FROM pages")
def j24(spark, sf):
    p = F.col("page_id")
    body = F.when(p % 3 == 0, F.unhex(F.lit("FFFE80"))).otherwise(F.col("html").cast("binary"))
    files = read(spark, sf, "pages").select(p.cast("string").alias("path"), F.lit("document").alias("kind"), body.alias("content"))
    return repository.extract(files).select(F.col("path").cast("long").alias("page_id"), (F.col("diagnostic").isNull() & F.col("text").isNotNull()).alias("read"))


@query("A28_vector_by_id", "SELECT vec_id AS id, 2 AS version FROM embeddings WHERE vec_id = 6")
def a28(spark, sf):
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.lit(1).alias("version"))
    return relational.upsert(v, v.withColumn("version", F.lit(2)), ["id"], ["version"]).where("id = 6")


@query("A34_newest_nodes", f"WITH {MEMORIES_SQL} SELECT 'memory:' || id AS id FROM (SELECT id FROM mem ORDER BY created_s DESC, id LIMIT 30)")
def a34(spark, sf):
    m = memories(spark, sf).orderBy(F.desc("created_at"), "id").limit(30)
    return graph.memory_graph(m.select(F.col("id").alias("memory_id"), F.lit("s").alias("session_id"), "memory_type", "title"))[0].select("id")


@query("A36_id_maps", "SELECT 'no reverse mapping' AS fault, count(*) AS n FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'record key', count(*) FROM customer WHERE c_custkey % 7 = 0")
def a36(spark, sf):
    from loomspan.sources.store import id_map_faults

    uuid = F.concat(F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.lit("-0000-0000-0000-000000000000"))
    m = read(spark, sf, "customer").select(uuid.alias("uuid"), F.col("c_custkey").alias("number"))
    records = m.select(F.col("uuid").alias("key"), F.when(F.col("number") % 7 == 0, "x").otherwise(F.col("uuid")).alias("id"))
    return id_map_faults(m, m.where("number % 10 <> 0").select("number", "uuid"), records).groupBy("fault").agg(F.count("*").alias("n"))


@query("B21_claims_list", f"WITH {MEMORIES_SQL} SELECT m.id, coalesce(CASE WHEN m.id % 3 <> 0 THEN 'decision' END, m.memory_type) AS claim_type FROM mem m")
def b21(spark, sf):
    m = memories(spark, sf)
    c = m.where("id % 3 <> 0").select("id", F.lit("decision").alias("claim_type"))
    return m.join(c, "id", "left").select("id", F.coalesce("claim_type", "memory_type").alias("claim_type"))


@query("B19_clean_text", "SELECT doc_id, text || ' end' AS t FROM documents")
def b19(spark, sf):
    dirty = F.concat(F.col("text"), F.lit("\\u0000"), F.lit("\x00 end"))
    return read(spark, sf, "documents").select("doc_id", text.clean_nul(dirty).alias("t"))


PAIRS_SQL = "t AS (SELECT page_id, page_id % 5 AS g, list_distinct(regexp_extract_all(lower(regexp_replace(html, '<[^>]*>', ' ', 'g')), '[a-z0-9_]{3,}')) AS w FROM pages)"


@query("C12_file_similarity", f"WITH {PAIRS_SQL} SELECT a.page_id AS l, b.page_id AS r, len(list_intersect(a.w, b.w))::INT AS shared FROM t a JOIN t b ON a.g = b.g AND a.page_id < b.page_id AND len(list_intersect(a.w, b.w)) >= 4 AND len(list_intersect(a.w, b.w)) >= 0.5 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))")
def c12(spark, sf):
    words = text.word_tokens(F.regexp_replace("html", "<[^>]*>", " "))
    p = read(spark, sf, "pages").select("page_id", (F.col("page_id") % 5).alias("g"), words.alias("w"))
    return graph.similar_pairs(p, "page_id", "w", ["g"]).select(F.col("left").alias("l"), F.col("right").alias("r"), "shared")


@query("C11_memory_similarity", f"WITH {MEMORIES_SQL}, t AS (SELECT id, project_id, list_distinct(regexp_extract_all(lower(content), '[a-z0-9_]{{3,}}')) AS w FROM mem) SELECT a.id AS l, b.id AS r FROM t a JOIN t b ON a.project_id = b.project_id AND a.id < b.id AND len(list_intersect(a.w, b.w)) >= 4 AND len(list_intersect(a.w, b.w)) >= 0.5 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))")
def c11(spark, sf):
    # A document is a memory once for each of its labels. Texts are not joined with labels for that: pairs, of which there are few, are multiplied.
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("project_id"), text.word_tokens(F.col("text")).alias("w"))
    pairs = graph.similar_pairs(d, "id", "w", ["project_id"]).select(F.col("left").alias("l"), F.col("right").alias("r"))
    times = read(spark, sf, "labels").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    for side in ("l", "r"):
        pairs = pairs.join(times.withColumnsRenamed({"doc_id": side, "n": "n_" + side}), side, "left")
    return pairs.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("n_l", F.lit(1)) * F.coalesce("n_r", F.lit(1))))).select("l", "r")


@query("C13_candidate_sessions", f"WITH {TELEMETRY_SQL}, s AS (SELECT DISTINCT session_id, CAST(session_id AS INT) % 4 AS p FROM ev), n AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY session_id) AS r FROM s) SELECT a.session_id, count(b.session_id) AS candidates FROM n a LEFT JOIN n b ON a.p = b.p AND b.r < a.r AND b.r >= a.r - 20 GROUP BY 1 HAVING count(b.session_id) > 0")
def c13(spark, sf):
    s = telemetry(spark, sf).select("session_id").distinct().withColumns({"project_id": F.col("session_id").cast("int") % 4, "ended_at": F.lit(0), "files": F.array(F.lit("x"))})
    return graph.continuity_edges(s).groupBy(F.substring("target", 9, 100).alias("session_id")).agg(F.count("*").alias("candidates"))


CODE_SQL = "sym AS (SELECT DISTINCT 'd' || (c_custkey % 7) || '/f' || (c_custkey % 50) AS target, 'fn' || (c_custkey * 7 % 211) AS name FROM customer), imp AS (SELECT DISTINCT 'd' || (c_custkey % 7) || '/f' || (c_custkey % 50) AS path, 'd' || (c_custkey * 3 % 7) || '/f' || (c_custkey * 3 % 50) AS target FROM customer WHERE c_custkey % 4 = 0), cal AS (SELECT DISTINCT 'd' || (o_orderkey % 7) || '/f' || (o_orderkey % 50) AS path, 'fn' || (o_orderkey % 300) AS name FROM orders)"


@query("C16_call_resolution", f"WITH {CODE_SQL}, x AS (SELECT c.path, c.name, s.target, i.path IS NOT NULL AS near, split_part(c.path, '/', 1) = split_part(s.target, '/', 1) AS beside FROM cal c JOIN sym s USING (name) LEFT JOIN imp i ON i.path = c.path AND i.target = s.target), g AS (SELECT path, name, count(*) AS n, min(target) AS first, count(*) FILTER (near) AS ni, min(target) FILTER (near) AS ti, count(*) FILTER (beside) AS nb, min(target) FILTER (beside) AS tb FROM x GROUP BY 1, 2) SELECT path, name, CASE WHEN n = 1 THEN first WHEN ni = 1 THEN ti WHEN nb = 1 THEN tb ELSE first END AS target, CASE WHEN n = 1 OR ni = 1 THEN 'resolved' WHEN nb = 1 THEN 'inferred' ELSE 'ambiguous' END AS evidence FROM g")
def c16(spark, sf):
    from loomspan.sources.code import resolve_calls

    c, o = F.col("c_custkey"), F.col("o_orderkey")
    path = lambda x: F.concat(F.lit("d"), (x % 7).cast("string"), F.lit("/f"), (x % 50).cast("string"))
    name = lambda x: F.concat(F.lit("fn"), x.cast("string"))
    customers = read(spark, sf, "customer")
    symbols = customers.select(path(c).alias("path"), name(c * 7 % 211).alias("name")).distinct()
    imports = customers.where(c % 4 == 0).select(path(c).alias("path"), path(c * 3).alias("target"))
    calls = read(spark, sf, "orders").select(path(o).alias("path"), F.lit(None).cast("string").alias("owner"), name(o % 300).alias("name"))
    return resolve_calls(calls, symbols, imports).select("path", "name", "target", "evidence")


@query("C17_import_resolution", "WITH f AS (SELECT page_id, 'src/m' || page_id || (['', '.ts', '.py', '/index.js', '.go'])[CAST(page_id % 5 + 1 AS INT)] AS path FROM pages) SELECT 'src/m' || i.page_id AS name, f.path AS target FROM pages i JOIN f ON f.page_id = i.page_id WHERE i.page_id % 5 <> 4")
def c17(spark, sf):
    from loomspan.sources.code import resolve_imports

    p = F.col("page_id")
    ends = F.element_at(F.array(*map(F.lit, ("", ".ts", ".py", "/index.js", ".go"))), (p % 5 + 1).cast("int"))
    base = F.concat(F.lit("src/m"), p.cast("string"))
    pages = read(spark, sf, "pages")
    imports = pages.select(F.lit("src/main.ts").alias("path"), F.concat(F.lit("./m"), p.cast("string")).alias("name"))
    return resolve_imports(imports, pages.select(F.concat(base, ends).alias("path"))).select(F.concat(F.lit("src/"), F.substring("name", 3, 100)).alias("name"), "target")


@query("C19_snapshot_heads", "SELECT o_custkey % 20 AS project_id, o_orderpriority AS layer, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS snapshot_id FROM orders GROUP BY 1, 2")
def c19(spark, sf):
    o = read(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("project_id"), F.col("o_orderpriority").alias("layer"), F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("created_at"))
    return relational.latest(o, ["project_id", "layer"], ["created_at", "snapshot_id"]).select("project_id", "layer", "snapshot_id")


@query("D24_category_counts", f"WITH {PAGE_NODES_SQL} SELECT CASE kind WHEN 'file' THEN 'files' WHEN 'module' THEN 'files' WHEN 'document' THEN 'docs' WHEN 'section' THEN 'docs' WHEN 'rationale' THEN 'docs' ELSE 'claims' END AS category, count(*) AS n FROM pn GROUP BY 1")
def d24(spark, sf):
    return page_nodes(spark, sf).groupBy(graph.category(F.col("node_type")).alias("category")).agg(F.count("*").alias("n"))


VARIANTS = "('quequ', 'queque', 'queques', 'quequed', 'quequing')"
WORDS_SQL = "tok AS (SELECT doc_id, t, p FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents)))"


def _documents(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("title"), F.lit("").alias("summary"), F.col("text").alias("content"))


@query("E01_search_document", f"WITH {WORDS_SQL} SELECT doc_id AS id, 'content' AS field, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS positions FROM tok WHERE t IN {VARIANTS} GROUP BY 1")
def e01(spark, sf):
    found = retrieval.index(_documents(spark, sf)).where("term = 'quequ'")
    return found.select("id", "field", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


@query("E04_cover_density", f"WITH {WORDS_SQL} SELECT doc_id AS id, round(count(*) * 0.2, 6)::DOUBLE AS rank FROM tok WHERE t IN {VARIANTS} GROUP BY 1")
def e04(spark, sf):
    return retrieval.match(_documents(spark, sf), "queque").select("id", "rank")


@query("E50_index_search", f"WITH {WORDS_SQL} SELECT doc_id AS id, round(count(*) * 0.2, 6)::DOUBLE AS rank FROM tok WHERE t IN {VARIANTS} GROUP BY 1")
def e50(spark, sf):
    return retrieval.search_index(retrieval.index(_documents(spark, sf)), "queque")


TAGS = ("html", "head", "body", "nav", "ul", "li", "a", "article", "h1", "div", "footer", "title", "style", "script")
OWNING_TAGS = ("html", "head", "body", "nav", "article", "div", "footer", "li")
_TAGS_SQL = f"""WITH raw AS (SELECT page_id, unnest(g) AS g, generate_subscripts(g, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '</?(?:{'|'.join(TAGS)})\\b[^>]*>') AS g FROM pages)),
walk AS (SELECT page_id, pos, g[2] <> '/' AS opens, regexp_extract(g, '^</?([a-z0-9]+)', 1) AS tag, sum(CASE WHEN g[2] = '/' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS level FROM raw),
op AS (SELECT * FROM walk WHERE opens),
latest AS (SELECT c.page_id, c.pos, o.level, max(o.pos) AS at FROM op c JOIN op o ON c.page_id = o.page_id AND o.pos < c.pos AND o.level < c.level GROUP BY 1, 2, 3),
own AS (SELECT l.page_id, l.pos, arg_max(o.tag, l.level) AS owner FROM latest l JOIN op o ON o.page_id = l.page_id AND o.pos = l.at WHERE o.tag IN {OWNING_TAGS} GROUP BY 1, 2)
SELECT c.page_id, own.owner, c.tag, count(*) AS n FROM op c LEFT JOIN own ON own.page_id = c.page_id AND own.pos = c.pos WHERE c.tag IN {OWNING_TAGS} GROUP BY 1, 2, 3"""


@query("J22_tag_owners", _TAGS_SQL)
def j22(spark, sf):
    tokens = nesting.tag_tokens(read(spark, sf, "pages"), "page_id", "html", TAGS, OWNING_TAGS)
    return nesting.owners(tokens, "page_id").groupBy("page_id", "owner", F.col("name").alias("tag")).agg(F.count("*").alias("n"))


@query("E50_top_search", f"WITH {WORDS_SQL} SELECT doc_id AS id, round(count(*) * 0.2, 6)::DOUBLE AS rank FROM tok WHERE t IN {VARIANTS} GROUP BY 1 ORDER BY rank DESC, id LIMIT 20")
def e50_top(spark, sf):
    """The first 20 from a written index: levels of the term's count are read from the highest down."""
    index = PostingIndex(spark, shared_folder(spark, "postings"), buckets=8)
    index.build(_documents(spark, sf))
    return index.top("queque", 20).rows


@query("E10_scoped_search", "WITH s AS (SELECT e.vec_id AS id, greatest(0, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q) SELECT id, round(s, 6) AS similarity FROM s ORDER BY round(s, 9) DESC, id LIMIT 7")
def e10(spark, sf):
    e = read(spark, sf, "embeddings")
    q = list(e.where("vec_id = 1").first()["embedding"])
    return retrieval.nearest(e.select(F.col("vec_id").alias("id"), "embedding"), q, 7).select("id", six(F.col("similarity")).alias("similarity"))


@query("E11_collection_search", "WITH s AS (SELECT e.vec_id AS id, greatest(0, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 2) q WHERE e.label = 4) SELECT id, round(1 - round(s, 9), 6) AS distance FROM s ORDER BY round(s, 9) DESC, id LIMIT 5")
def e11(spark, sf):
    e = read(spark, sf, "embeddings")
    q = list(e.where("vec_id = 2").first()["embedding"])
    return retrieval.nearest_typed(e.select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("collection")), q, 5, [4]).select("id", six(F.col("distance")).alias("distance"))


def _signal_sql(expression: str) -> str:
    return f"WITH {MEMORIES_SQL} SELECT id, round(({expression})::DOUBLE, 6) AS score FROM mem"


def _signal(spark, sf, request: ranking.Request, **values):
    """Final scores of memories of which all but the given columns are neutral, less the recency of now."""
    none, plain = F.lit(None).cast("double"), F.lit(None).cast("string")
    neutral = {c: none for c in ("lexical_score", "semantic_score", "graph_proximity", "importance", "confidence", "community_score")} | {c: plain for c in ("authority", "verification", "governance", "superseded_by", "branch")}
    neutral |= {"memory_type": F.lit("other"), "title": F.lit(""), "conflicts": F.lit(0), "created_at": F.lit(NOW), "session_ids": F.array().cast("array<string>")}
    m = memories(spark, sf)
    kept = {k: v if not isinstance(v, str) else F.col(v) for k, v in values.items()}
    return ranking.fuse(m.withColumns({k: v for k, v in (neutral | kept).items() if not (k in values and values[k] == k)}), request).select("id", six(F.col("final_score") - 0.08).alias("score"))


REPO = {"intent": "repository_only", "now": NOW}


@query("E19_type_fit", _signal_sql("CASE WHEN memory_type IN ('fact', 'risk') THEN 0.25 ELSE -0.15 END + CASE memory_type WHEN 'decision' THEN 0.16 WHEN 'fact' THEN 0.16 WHEN 'implementation_detail' THEN 0.16 WHEN 'constraint' THEN 0.16 WHEN 'fix' THEN 0.16 WHEN 'task' THEN 0.08 WHEN 'open_question' THEN -0.04 WHEN 'summary' THEN -0.14 ELSE 0 END"))
def e19(spark, sf):
    return _signal(spark, sf, ranking.Request(types=("fact", "risk"), **REPO), memory_type="memory_type")


@query("E20_community_boost", _signal_sql("community_score * 0.15"))
def e20(spark, sf):
    return _signal(spark, sf, ranking.Request(**REPO), community_score="community_score")


@query("E22_governance_boost", _signal_sql("CASE governance WHEN 'pinned' THEN 0.20 WHEN 'rejected' THEN -0.80 ELSE 0 END"))
def e22(spark, sf):
    return _signal(spark, sf, ranking.Request(**REPO), governance="governance")


@query("E26_session_relevance", _signal_sql("CASE WHEN session_ids[1] = '3' THEN 0.12 + 0.5 WHEN branch = 'b1' THEN 0.45 * 0.12 ELSE 0 END"))
def e26(spark, sf):
    return _signal(spark, sf, ranking.Request(session_id="3", branch="b1", **REPO), session_ids="session_ids", branch="branch")


@query("E27_graph_proximity", _signal_sql("graph_proximity * 0.10"))
def e27(spark, sf):
    return _signal(spark, sf, ranking.Request(**REPO), graph_proximity="graph_proximity")


@query("E29_freshness_penalty", _signal_sql("CASE WHEN (1767225600 - created_s) / 86400.0 <= 1 THEN 0.08 WHEN (1767225600 - created_s) / 86400.0 <= 7 THEN 0.068 WHEN (1767225600 - created_s) / 86400.0 <= 30 THEN 0.052 WHEN (1767225600 - created_s) / 86400.0 <= 90 THEN 0.032 ELSE 0.016 END - 0.08 - CASE WHEN (1767225600 - created_s) / 86400.0 > 90 THEN 0.02 ELSE 0 END"))
def e29(spark, sf):
    return _signal(spark, sf, ranking.Request(**REPO), created_at="created_at")


@query("E36_diversity_keys", f"WITH {SEARCH_SQL}, s AS (SELECT id, label, kind, source_file, source_id, {_score_sql('blog')} AS score FROM low) SELECT coalesce(source_file, source_id) AS source, least(count(*), 2) AS kept FROM s WHERE score > 0 AND kind NOT IN ('file', 'document') GROUP BY 1")
def e36(spark, sf):
    n = page_nodes(spark, sf)
    found = traverse.search_nodes(n.where(~F.col("node_type").isin("file", "document")), "blog", 1_000_000)
    return found.groupBy(F.coalesce(F.col("metadata")["sourceFile"], "source_id").alias("source")).agg(F.count("*").alias("kept"))


@query("E47_family_keys", f"WITH {MEMORIES_SQL} SELECT id, coalesce(nullif({CANON('title')}, ''), {CANON('summary')}) AS family FROM mem")
def e47(spark, sf):
    return memories(spark, sf).select("id", ranking.family_key(F.col("title"), F.col("summary")).alias("family"))


@query("F07_consecutive_pairs", f"WITH {TELEMETRY_SQL}, {EPISODES_SQL}, ep AS (SELECT DISTINCT session_id, episode FROM eps) SELECT 'episode:' || session_id || ':' || episode AS source, 'episode:' || session_id || ':' || nxt AS target FROM (SELECT *, lead(episode) OVER (PARTITION BY session_id ORDER BY episode) AS nxt FROM ep) WHERE nxt IS NOT NULL")
def f07(spark, sf):
    e = events.materialise_episodes(events.episodes_of(telemetry(spark, sf), gap_seconds=86400, cap=2))
    return graph.episode_graph(e)[1].where("relation = 'related_to'").select("source", "target")


@query("F11_top_communities", f"WITH {GRAPH_SQL}, m AS (SELECT id, node_type AS c FROM nodes), z AS (SELECT c, count(*) AS n FROM m GROUP BY 1) SELECT c AS community, n AS node_count FROM z ORDER BY n DESC, c LIMIT 8")
def f11(spark, sf):
    n, e = order_graph(spark, sf)
    return graph.community_figures(n.select("id", F.col("node_type").alias("community")), n, e).orderBy(F.desc("node_count"), "community").limit(8).select("community", "node_count")


@query("F17_relations_by_weight", f"WITH {GRAPH_SQL} SELECT source, target FROM edges WHERE relation <> 'places' ORDER BY weight DESC, source, target LIMIT 100")
def f17(spark, sf):
    n, e = order_graph(spark, sf)
    return graph.inject(n, e.limit(0), e.where("relation <> 'places'"), 100).select("source", "target")


@query("G06_set_once", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'first' ELSE 'second' END AS v FROM orders")
def g06(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "first").alias("v"))
    return relational.set_once(o, o.select("o_orderkey", F.lit("second").alias("v")), "o_orderkey", "v")


@query("G08_two_sources", "SELECT doc_id AS id, doc_id % 2 = 0 AS lexical, doc_id % 3 = 0 AS semantic FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def g08(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    both = ranking.merge_hybrid(d.where("id % 2 = 0").withColumn("score", F.lit(0.5)), d.where("id % 3 = 0").withColumn("distance", F.lit(1.0)))
    return both.select("id", F.col("lexical_score").isNotNull().alias("lexical"), F.col("semantic_score").isNotNull().alias("semantic"))


@query("G13_edge_dedupe", f"WITH {GRAPH_SQL}, u AS (SELECT source, target, relation, weight FROM edges UNION ALL SELECT source, target, relation, weight + 1 FROM edges WHERE relation = 'located_in') SELECT source, target, relation, max(weight)::DOUBLE AS weight FROM u GROUP BY 1, 2, 3")
def g13(spark, sf):
    _, e = order_graph(spark, sf)
    again = e.where("relation = 'located_in'").withColumn("weight", F.col("weight") + 1)
    return graph.merge_edges(e.withColumn("position", F.lit(1)).unionByName(again.withColumn("position", F.lit(2)))).select("source", "target", "relation", "weight")


@query("G12_object_merge", "SELECT event_id, 'own' AS a, 'patch' AS b, 'new' AS c FROM events")
def g12(spark, sf):
    m = relational.merge_maps(F.create_map(F.lit("a"), F.lit("own"), F.lit("b"), F.lit("own")), F.create_map(F.lit("b"), F.lit("patch"), F.lit("c"), F.lit("new")))
    return read(spark, sf, "events").select("event_id", *[m[k].alias(k) for k in "abc"])


@query("H17_derivations", f"WITH {MEMORIES_SQL} SELECT id, CASE WHEN id % 4 = 0 THEN 'summary_claim' WHEN memory_type IN ('summary', 'risk', 'change_log') THEN 'claim' ELSE memory_type || '_claim' END AS derivation FROM mem")
def h17(spark, sf):
    return memories(spark, sf).select("id", claims.derivation(F.col("memory_type"), F.col("id") % 4 == 0).alias("derivation"))


@query("I06_known_types", f"WITH {MEMORIES_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN 'fact' ELSE memory_type END AS memory_type FROM mem")
def i06(spark, sf):
    from loomspan.schemas import MEMORY_TYPES, known

    return memories(spark, sf).select("id", known(F.when(F.col("id") % 3 == 0, "legacy_kind").otherwise(F.col("memory_type")), MEMORY_TYPES, "fact").alias("memory_type"))


@query("J08_file_mentions", MENTION_SQL)
def j08(spark, sf):
    return c14(spark, sf)


@query("J26_incremental_edges", f"WITH {GRAPH_SQL}, kept AS (SELECT id FROM nodes WHERE NOT (node_type = 'order' AND CAST(split_part(id, ':', 2) AS BIGINT) % 3 = 0)) SELECT source, target FROM edges WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept)")
def j26(spark, sf):
    n, e = order_graph(spark, sf)
    number = F.split_part("id", F.lit(":"), F.lit(2)).cast("long")
    n = n.withColumn("source_file", F.when((F.col("node_type") == "order") & (number % 3 == 0), "old.py").otherwise(F.col("id")))
    e = e.withColumn("source_file", F.col("source"))
    return graph.incremental_sync(n, e, n.limit(0), e.limit(0), spark.createDataFrame([("old.py",)], "path string"))[1].select("source", "target")


@query("K07_goal_coverage", "SELECT page_id, array_to_string(list_filter([CASE WHEN contains(url, 'en') THEN '0' END, CASE WHEN contains(url, 'blog') THEN '1' END, CASE WHEN contains(url, 'http') THEN '2' END, CASE WHEN contains(url, 'zzz') THEN '3' END], lambda x: x IS NOT NULL), ',') AS covered FROM pages")
def k07(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.array_join(F.transform(traverse.coverage(F.col("url"), ["en", "blog", "http", "zzz"]), lambda x: x.cast("string")), ",").alias("covered"))


@query("K15_subset_components", f"WITH RECURSIVE {GRAPH_SQL}, s AS (SELECT id FROM nodes WHERE node_type IN ('nation', 'region')), l AS (SELECT source AS a, target AS b FROM edges WHERE source IN (SELECT id FROM s) AND target IN (SELECT id FROM s) UNION SELECT target, source FROM edges WHERE source IN (SELECT id FROM s) AND target IN (SELECT id FROM s)), reach AS (SELECT DISTINCT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM reach r JOIN l ON l.a = r.seen) SELECT node, min(seen) AS component FROM reach GROUP BY 1")
def k15(spark, sf):
    n, e = order_graph(spark, sf)
    return components.components(traverse.induced(e, n.where("node_type in ('nation', 'region')")), "source", "target")


@query("K17_hub_types", f"WITH {GRAPH_SQL} SELECT id, CASE WHEN node_type = 'session' THEN 'session_hub' WHEN node_type = 'module' THEN 'import_hub' WHEN node_type IN ('file', 'document') AND degree > 50 THEN 'central_file' ELSE 'domain_hub' END AS hub FROM (SELECT id, CASE node_type WHEN 'region' THEN 'session' WHEN 'nation' THEN 'file' WHEN 'customer' THEN 'module' ELSE node_type END AS node_type, degree FROM degree)")
def k17(spark, sf):
    n, e = order_graph(spark, sf)
    kind = lookup(F.col("node_type"), {"region": "session", "nation": "file", "customer": "module", "order": "order"}, None)
    return n.join(graph.degrees(n, e).select("id", "degree"), "id").select("id", graph.hub_type(kind, F.col("degree")).alias("hub"))


@query("K14_partition_quality", f"WITH {GRAPH_SQL}, m AS (SELECT id, CASE WHEN node_type IN ('nation', 'region') THEN 0 ELSE 1 END AS c FROM nodes), b AS (SELECT source AS a, target AS b, weight AS w FROM edges UNION ALL SELECT target, source, weight FROM edges), t AS (SELECT x.c, sum(w) AS tot, sum(CASE WHEN x.c = y.c THEN w ELSE 0 END) AS inn FROM b JOIN m x ON x.id = b.a JOIN m y ON y.id = b.b GROUP BY 1) SELECT round(sum(inn / s - (tot / s) ** 2), 6)::DOUBLE AS modularity FROM t, (SELECT sum(tot) AS s FROM t)")
def k14(spark, sf):
    from loomspan.operators import cluster

    n, e = order_graph(spark, sf)
    return cluster.modularity(e, n.select("id", F.when(F.col("node_type").isin("nation", "region"), 0).otherwise(1).alias("community")))


@query("L03_buckets_and_quotas", f"WITH {ITEMS_SQL} SELECT item_id, CASE WHEN source_class = 'memory' THEN 'memory:' || memory_type ELSE source_class END AS bucket, CASE source_class WHEN 'repository' THEN 4 ELSE 2 END AS quota FROM items")
def l03(spark, sf):
    return _items(spark, sf).select("item_id", context.bucket().alias("bucket"), context.quota("hybrid").alias("quota"))


@query("L09_filler", f"WITH RECURSIVE {_cover_sql(500, ('decisions', 'active_tasks', 'facts'))} SELECT request_id, item_id, place FROM chosen WHERE stage = 'filler'")
def l09(spark, sf):
    return context.compile_cover(_items(spark, sf).withColumn("goals", context.goals_of(F.lit("x"))), 500).where("stage = 'filler'").select("request_id", "item_id", "place")


@query("L11_conflict_split", f"WITH {MEMORIES_SQL} SELECT id, CASE WHEN conflicts > 0 THEN 'conflict' ELSE 'memory' END AS source_class FROM mem")
def l11(spark, sf):
    own, bad = context.conflict_split(memories(spark, sf).select("id", "conflicts", "verification"))
    return own.unionByName(bad).select("id", "source_class")


@query("L12_node_items", f"WITH {PAGE_NODES_SQL} SELECT id AS item_id, label || '; type ' || kind || '; from repository' AS summary FROM pn")
def l12(spark, sf):
    return context.graph_items(page_nodes(spark, sf)).select("item_id", "summary")


@query("M04_regex_replace", "SELECT doc_id, regexp_replace(text, '[0-9]+', '#', 'g') AS t FROM documents")
def m04(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[0-9]+", "#").alias("t"))


@query("M10_times", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS s FROM events")
def m10(spark, sf):
    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    said = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return e.select("event_id", F.unix_timestamp(text.instant(said, F.timestamp_seconds(F.lit(0)))).alias("s"))


@query("M12_rounding", "SELECT o_orderkey, round(o_totalprice / 7, 2)::DOUBLE AS two FROM (SELECT o_orderkey, o_totalprice::DOUBLE AS o_totalprice FROM orders)")
def m12(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice").cast("double") / 7, 2).alias("two"))


@query("M13_arithmetic", "SELECT p_partkey, least(p_size, 20) AS low, round(sqrt(p_size), 6) AS root, round(ln(p_size + 1), 6) AS log, p_size ** 2 AS square FROM (SELECT p_partkey, p_size::DOUBLE AS p_size FROM part)")
def m13(spark, sf):
    s = F.col("p_size").cast("double")
    return read(spark, sf, "part").select("p_partkey", F.least(s, F.lit(20.0)).alias("low"), six(F.sqrt(s)).alias("root"), six(F.log(s + 1)).alias("log"), F.pow(s, F.lit(2.0)).alias("square"))


@query("M14_bits", "SELECT event_id, xor(event_id, 255) AS x, event_id & 15 AS low, event_id >> 2 AS half FROM events")
def m14(spark, sf):
    e = F.col("event_id")
    return read(spark, sf, "events").select("event_id", e.bitwiseXOR(F.lit(255)).alias("x"), e.bitwiseAND(F.lit(15)).alias("low"), F.shiftright(e, 2).alias("half"))


@query("M16_json", "SELECT n_nationkey, '{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS j FROM nation")
def m16(spark, sf):
    return read(spark, sf, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))).alias("j"))


@query("M18_uuid_shape", "SELECT count(*) AS n, count(*) AS distinct_ids, true AS all_valid FROM customer")
def m18(spark, sf):
    c = read(spark, sf, "customer").withColumn("u", F.expr("uuid()"))
    from loomspan.plans.lineage import cut

    c = cut(c.select("u"))
    return c.agg(F.count("*").alias("n"), F.countDistinct("u").alias("distinct_ids"), F.bool_and(F.col("u").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).alias("all_valid"))


@query("M19_null_rules", "SELECT event_id, coalesce(nullif(event_type, 'view'), 'seen') AS a, TRY_CAST(props AS INT) AS b FROM events")
def m19(spark, sf):
    return read(spark, sf, "events").select("event_id", F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("seen")).alias("a"), F.col("props").try_cast("int").alias("b"))


@query("M20_percentages", "SELECT p_partkey, printf('%.0f%%', p_size::DOUBLE) AS share FROM part")
def m20(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.format_string("%.0f%%", F.col("p_size").cast("double")).alias("share"))


@query("N06_once_per_key", "SELECT user_id AS session_id, event_id // 2 AS k, min(event_id) AS first FROM events GROUP BY 1, 2")
def n06(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.expr("event_id div 2").alias("idempotency_key"), F.col("event_id").cast("string").alias("event_id"), F.col("event_id").alias("position"))
    kept = events.append_once(e.limit(0), e).where("not duplicate")
    return kept.select("session_id", F.col("idempotency_key").alias("k"), F.col("position").alias("first"))


@query("N11_heavy_limit", f"WITH {QUEUE_SQL}, x AS (SELECT * FROM (SELECT * FROM q WHERE status = 'pending' AND job_type <> 'build_graph' ORDER BY priority, i, job_id LIMIT 9) UNION ALL SELECT * FROM (SELECT * FROM q WHERE status = 'pending' AND job_type = 'build_graph' ORDER BY priority, i, job_id LIMIT 1)), y AS (SELECT * FROM x ORDER BY priority, i, job_id LIMIT 9) SELECT count(*) FILTER (job_type = 'build_graph') AS heavy, count(*) AS claimed FROM y")
def n11(spark, sf):
    got = jobs.claim(_queue(spark, sf), F.timestamp_seconds(F.lit(1767325600)), 9)
    return got.agg(F.count_if(F.col("job_type").isin(*jobs.HEAVY)).alias("heavy"), F.count("*").alias("claimed"))


@query("N17_worker_limit", f"WITH {TELEMETRY_SQL} SELECT session_id, least(count(*), 30) AS n FROM ev GROUP BY 1")
def n17(spark, sf):
    top = relational.top_per_key(telemetry(spark, sf), ["session_id"], [F.asc("created_at"), F.asc("ordinal")], 30)
    return top.groupBy("session_id").agg(F.count("*").alias("n"))


@query("J30_file_nodes", f"WITH {PATHS_SQL} SELECT 'file:' || path AS id, split_part(path, '/', 2) AS label FROM pth")
def j30(spark, sf):
    from loomspan.sources.code import code_graph, parts_of

    p = _paths(spark, sf).select("path", F.lit(None).cast("string").alias("language"), F.lit("").alias("text"))
    return code_graph(p.select("path"), parts_of(p))[0].where("node_type = 'file'").select("id", "label")


@query("J17_rationale_comments", "SELECT page_id, 'TODO' AS tag, 'mend page ' || page_id AS body FROM pages WHERE page_id % 2 = 0")
def j17(spark, sf):
    from loomspan.sources.code import parts_of

    note = F.concat(F.lit("x = 1\n"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("y = 2  # TODO: mend page "), F.col("page_id").cast("string"))).otherwise("# BUG: not a tag, nor TODO without its colon"))
    files = read(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("python").alias("language"), note.alias("text"))
    return parts_of(files).where("part = 'rationale'").select(F.col("path").cast("long").alias("page_id"), F.col("kind").alias("tag"), F.col("name").alias("body"))


@query("J14_python_symbols", "SELECT page_id, 'run' || page_id AS name, 'function' AS kind FROM pages UNION ALL SELECT page_id, 'Box', 'class' FROM pages UNION ALL SELECT page_id, 'open', 'method' FROM pages")
def j14(spark, sf):
    from loomspan.sources.code import parts_of

    code = F.concat(F.lit("def run"), F.col("page_id").cast("string"), F.lit("(x: int) -> str:\n    return helper(x)\n\nclass Box:\n    def open(self):\n        pass\n"))
    files = read(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("python").alias("language"), code.alias("text"))
    return parts_of(files).where("part = 'symbol'").select(F.col("path").cast("long").alias("page_id"), "name", "kind")


BITS_SQL = "list_transform({v}, lambda x: round((greatest(-1.0, least(1.0, x::DOUBLE)) + 1) / 2 * 15) / 7.5 - 1)"


CODES_SQL = f"WITH v AS (SELECT vec_id AS id, {BITS_SQL.format(v='embedding')} AS e FROM embeddings), s AS (SELECT v.id, round(greatest(0, list_cosine_similarity(v.e, q.e)), 9) AS s FROM v, (SELECT e FROM v WHERE id = 3) q) SELECT id, round(s, 6) AS similarity FROM s ORDER BY s DESC, id LIMIT 6"


@query("E12_quantised_search", CODES_SQL)
def e12_search(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.nearest_quantised(e, list(e.where("id = 3").first()["embedding"]), 6).select("id", six(F.col("similarity")).alias("similarity"))


@query("E12_code_search", CODES_SQL)
def e12_codes(spark, sf):
    """The same ranking from stored codes: the index is written once, a search reads keys, codes and lengths."""
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = VectorIndex(spark, shared_folder(spark, "codes"))
    index.build(e)
    q = e.where("id = 3").select(F.col("id").alias("query_id"), "embedding")
    return index.search_codes(q, 6, quantised_query=True).select("id", six(F.col("similarity")).alias("similarity"))



@query("A20_staged_merge", "SELECT event_id FROM (SELECT event_id, user_id, event_id // 3 AS k FROM events) WHERE event_id % 5 = 0 UNION SELECT min(event_id) FROM (SELECT event_id, user_id, event_id // 3 AS k FROM events) e WHERE event_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_id % 5 = 0 AND s.user_id = e.user_id AND s.event_id // 3 = e.k) GROUP BY user_id, k")
def a20(spark, sf):
    i = F.col("event_id")
    e = read(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.expr("event_id div 3").alias("idempotency_key"), i.cast("string").alias("event_id"), i.alias("position"))
    return events.merge_staged(e.where("position % 5 = 0"), e.where("position % 5 <> 0")).select(F.col("position").alias("event_id"))


@query("E40_memory_communities", "SELECT c_custkey AS community, lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '-0000-0000-0000-000000000000' AS memory_id FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 5 <> 0")
def e40(spark, sf):
    c = F.col("c_custkey")
    uuid = F.concat(F.lpad(c.cast("string"), 8, "0"), F.lit("-0000-0000-0000-000000000000"))
    m = read(spark, sf, "customer").select(F.concat(F.when(c % 4 == 0, "file:").otherwise("memory:"), uuid).alias("id"), F.when(c % 5 != 0, c).alias("community"))
    return graph.memory_communities(m)


@query("G14_graph_merge", f"WITH {GRAPH_SQL} SELECT source, target, relation, CASE WHEN relation = 'located_in' THEN 2.0 ELSE weight END::DOUBLE AS weight, CASE WHEN relation = 'located_in' THEN 'extracted' ELSE evidence END AS evidence FROM edges")
def g14(spark, sf):
    n, e = order_graph(spark, sf)
    again = e.where("relation = 'located_in'").withColumns({"weight": F.lit(2.0), "evidence": F.lit("extracted")})
    return graph.merged((n, e), (n.where("node_type = 'nation'"), again))[1].select("source", "target", "relation", "weight", "evidence")


@query("O05_sql_texts", f"SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z_]+', ' ', 'g'))) AS canonical, array_to_string(list_filter(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9_]+)', 1), lambda t: length(t) >= 3)[:10], '_') AS words, left(sha256(coalesce(text, '')), 32) AS id, len(list_filter(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9_./:+-]+)', 1), lambda t: length(t) >= 3)), lambda t: NOT list_contains([{', '.join(repr(w) for w in text.GOAL_STOPWORDS)}], t)))::BIGINT AS goals FROM documents")
def o05_texts(spark, sf):
    catalogue.register(spark)
    read(spark, sf, "documents").selectExpr("doc_id", "coalesce(text, '') AS text").createOrReplaceTempView("o05_documents")
    return spark.sql("SELECT doc_id, md5(canonical_text(text)) AS canonical, claim_text(text) AS words, stable_id(text) AS id, (SELECT count(*) FROM goals_in(text)) AS goals FROM o05_documents")


@query("O05_sql_scope", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 5 = 3 AND (c_custkey % 3 = 0 OR c_custkey % 2 = 1)")
def o05_scope(spark, sf):
    """The rows of a team's project, and those of no project, by the scope predicate."""
    catalogue.register(spark)
    catalogue.bind(spark, organization_id="BUILDING", team_id="3", project_id="1")
    read(spark, sf, "customer").createOrReplaceTempView("o05_customers")
    return spark.sql("SELECT c_custkey, c_name FROM o05_customers WHERE app_is_scoped_to_row(c_mktsegment, string(c_nationkey % 5), CASE WHEN c_custkey % 3 <> 0 THEN string(c_custkey % 2) END)")
