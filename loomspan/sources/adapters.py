"""Canonical tables from a star schema with an event table, documents, labels, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.text import claim_text
from loomspan.operators.claims import polarity
from loomspan.plans.lineage import read
from loomspan.schemas import AUTHORITY, MEMORY_TYPES, lookup

TELEMETRY = {"error": "error", "click": "tool_call", "view": "command", "purchase": "file_change", "signup": "test_result"}
ROLES = {"user": "prompt", "assistant": "response", "system": "turn_context"}
BASE = "timestamp'2026-01-01 00:00:00'"


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as session events: a user is a session, k names files and tools."""
    k = F.coalesce(F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("int"), F.lit(0))
    kind = lookup(F.col("event_type"), TELEMETRY, "annotation")
    return read(spark, sf_dir, "events").withColumns({"kind": kind, "k": k}).select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").cast("string").alias("event_id"), F.col("event_id").alias("ordinal"), F.col("kind").alias("event_type"),
        F.when(F.col("kind") == "error", F.concat(F.lit("Step "), F.col("k").cast("string"), F.lit(" failed at deadbeef0")) ).alias("message"),
        F.when(F.col("kind") == "command", F.concat(F.lit("Run  step"), (F.col("k") % 5).cast("string"), F.lit(" now --fast"))).alias("command"),
        F.when(F.col("kind").isin("tool_call", "test_result"), F.concat(F.lit("tool_"), (F.col("k") % 7).cast("string"))).alias("tool_name"),
        F.when(F.col("kind").isin("file_change", "error"), F.concat(F.lit("src/f"), F.col("k").cast("string"), F.lit(".py"))).alias("file_path"),
        F.when(F.col("value") > 50, 1).otherwise(0).alias("exit_code"), F.col("ts").cast("timestamp").alias("created_at"),
    )


TELEMETRY_SQL = """
ev AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(event_id AS VARCHAR) AS event_id, event_id AS ordinal, kind AS event_type,
    CASE WHEN kind = 'error' THEN 'Step ' || k || ' failed at deadbeef0' END AS message,
    CASE WHEN kind = 'command' THEN 'Run  step' || (k % 5) || ' now --fast' END AS command,
    CASE WHEN kind IN ('tool_call', 'test_result') THEN 'tool_' || (k % 7) END AS tool_name,
    CASE WHEN kind IN ('file_change', 'error') THEN 'src/f' || k || '.py' END AS file_path,
    CASE WHEN value > 50 THEN 1 ELSE 0 END AS exit_code, ts AS created_at
  FROM (SELECT *, coalesce(TRY_CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT), 0) AS k,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'tool_call' WHEN 'view' THEN 'command' WHEN 'purchase' THEN 'file_change'
      WHEN 'signup' THEN 'test_result' ELSE 'annotation' END AS kind FROM events))
"""


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as session events."""
    none = F.lit(None).cast("string")
    at = F.timestamp_seconds(F.lit(1767225600) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.concat_ws(":", "conv_id", "turn").alias("event_id"), F.col("turn").alias("ordinal"),
        lookup(F.col("role"), ROLES, "annotation").alias("event_type"), F.col("text").alias("message"), none.alias("command"), none.alias("tool_name"),
        none.alias("file_path"), F.lit(None).cast("int").alias("exit_code"), at.alias("created_at"),
    )


CHAT_SQL = """
chat AS (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS ordinal,
    CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'response' WHEN 'system' THEN 'turn_context' ELSE 'annotation' END AS event_type,
    text AS message FROM conversations)
"""


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels as memories and their claims."""
    labels = read(spark, sf_dir, "labels")
    i = F.col("doc_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (i % n + 1).cast("int"))
    return read(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        i.alias("id"), i.cast("string").alias("claim_id"), F.col("source").alias("project_id"), F.left("text", F.lit(80)).alias("title"), F.left("text", F.lit(300)).alias("summary"),
        F.col("text").alias("content"), pick(MEMORY_TYPES, 11).alias("memory_type"), pick(AUTHORITY, 6).alias("authority"),
        F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "unverified").otherwise("inferred").alias("verification"),
        F.when(F.col("toxic") == 1, "rejected").when(i % 13 == 0, "pinned").otherwise("active").alias("governance"), (i % 5 != 0).alias("admitted"),
        F.when(i % 17 == 0, (i + 1).cast("string")).alias("superseded_by"), F.lit(None).cast("timestamp").alias("superseded_at"), F.lit(None).cast("timestamp").alias("valid_to"),
        polarity(F.col("text")).alias("polarity"), F.concat_ws(":", F.lit("fact"), F.col("source"), claim_text(F.col("text"))).alias("claim_key"),
        F.concat(F.lit("s"), (i % 50).cast("string")).alias("subject"),
        ((i % 10) / 10.0).alias("importance"), ((i % 8) / 8.0).alias("confidence"), (i % 4).alias("conflicts"),
        F.array((i % 20).cast("string")).alias("session_ids"), F.concat(F.lit("b"), (i % 3).cast("string")).alias("branch"),
        ((i % 6) / 6.0).alias("graph_proximity"), ((i % 3) / 3.0).alias("community_score"), ((i % 9) / 9.0).alias("lexical_score"), ((i % 7) / 7.0).alias("semantic_score"),
        F.timestamp_seconds(F.lit(1767225600) - i * 36000).alias("created_at"), F.timestamp_seconds(F.lit(1767225600) - i * 36000).alias("valid_from"),
    )


MEMORIES_SQL = """
mem AS (
  SELECT d.doc_id AS id, CAST(d.doc_id AS VARCHAR) AS claim_id, source AS project_id, left(text, 80) AS title, left(text, 300) AS summary, text AS content,
    (['fact','decision','task','constraint','bug','fix','open_question','summary','implementation_detail','change_log','risk'])[CAST(d.doc_id % 11 + 1 AS INT)] AS memory_type,
    (['repository','user_confirmed','tool_verified','test_verified','session_derived','model_derived'])[CAST(d.doc_id % 6 + 1 AS INT)] AS authority,
    CASE WHEN quality = 1 THEN 'verified' WHEN quality = 0 THEN 'unverified' ELSE 'inferred' END AS verification,
    CASE WHEN toxic = 1 THEN 'rejected' WHEN d.doc_id % 13 = 0 THEN 'pinned' ELSE 'active' END AS governance, d.doc_id % 5 <> 0 AS admitted,
    CASE WHEN d.doc_id % 17 = 0 THEN CAST(d.doc_id + 1 AS VARCHAR) END AS superseded_by, CAST(NULL AS TIMESTAMP) AS superseded_at, CAST(NULL AS TIMESTAMP) AS valid_to,
    CASE WHEN regexp_matches(lower(text), 'do not|should not|not |disabled|rejected|fallback only') THEN 'negative' ELSE 'positive' END AS polarity,
    'fact:' || source || ':' || array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda t: length(t) >= 3)[1:10], '_') AS claim_key,
    's' || (d.doc_id % 50) AS subject,
    (d.doc_id % 10) / 10.0::DOUBLE AS importance, (d.doc_id % 8) / 8.0::DOUBLE AS confidence, d.doc_id % 4 AS conflicts,
    [CAST(d.doc_id % 20 AS VARCHAR)] AS session_ids, 'b' || (d.doc_id % 3) AS branch, (d.doc_id % 6) / 6.0::DOUBLE AS graph_proximity,
    (d.doc_id % 3) / 3.0::DOUBLE AS community_score, (d.doc_id % 9) / 9.0::DOUBLE AS lexical_score, (d.doc_id % 7) / 7.0::DOUBLE AS semantic_score,
    1767225600 - d.doc_id * 36000 AS created_s
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


def order_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers, nations, regions and orders as a property graph."""
    o = read(spark, sf_dir, "orders")
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    name = lambda kind, key: F.concat(F.lit(kind + ":"), F.col(key).cast("string"))
    node = lambda df, kind, key, label: df.select(name(kind, key).alias("id"), label.alias("label"), F.lit(kind).alias("node_type"), F.lit("table").alias("source_type"), F.col(key).cast("string").alias("source_id"), F.lit(None).cast("string").alias("source_file"))
    nodes = (
        node(o, "order", "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")))
        .union(node(c, "customer", "c_custkey", F.col("c_name"))).union(node(n, "nation", "n_nationkey", F.col("n_name"))).union(node(r, "region", "r_regionkey", F.col("r_name")))
    )
    edge = lambda df, a, b, rel, ev, w: df.select(a.alias("source"), b.alias("target"), F.lit(rel).alias("relation"), F.lit(ev).alias("evidence"), F.lit(w).alias("weight"))
    edges = (
        edge(o, name("customer", "o_custkey"), name("order", "o_orderkey"), "places", "extracted", 1.0)
        .union(edge(c, name("customer", "c_custkey"), name("nation", "c_nationkey"), "located_in", "inferred", 0.5))
        .union(edge(n, name("nation", "n_nationkey"), name("region", "n_regionkey"), "part_of", "ambiguous", 0.25))
    )
    return nodes, edges


GRAPH_SQL = """
o AS (SELECT * FROM orders),
c AS (SELECT * FROM customer),
nodes AS (
  SELECT 'order:' || o_orderkey AS id, 'Order ' || o_orderkey AS label, 'order' AS node_type FROM o
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'customer' FROM c
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation' FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, r_name, 'region' FROM region),
edges AS (
  SELECT 'customer:' || o_custkey AS source, 'order:' || o_orderkey AS target, 'places' AS relation, 'extracted' AS evidence, 1.0::DOUBLE AS weight FROM o
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located_in', 'inferred', 0.5 FROM c
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'part_of', 'ambiguous', 0.25 FROM nation),
ends AS (SELECT source AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT target, 1, 0 FROM edges),
degree AS (SELECT n.id, n.node_type, n.label, coalesce(sum(i), 0)::BIGINT AS in_degree, coalesce(sum(o), 0)::BIGINT AS out_degree, count(e.id) AS degree
  FROM nodes n LEFT JOIN ends e ON n.id = e.id GROUP BY ALL)
"""


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as nodes of six kinds, with metadata as a repository's nodes have."""
    url = F.col("url")
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    path = F.concat(F.when(F.col("page_id") % 7 == 0, "build/").otherwise(""), F.regexp_extract(url, "://[^/?#]*/?([^?#]*)", 1))
    kind = F.element_at(F.array(*map(F.lit, ("file", "document", "symbol", "module", "section", "rationale"))), (F.col("page_id") % 6 + 1).cast("int"))
    rows = read(spark, sf_dir, "pages").select("page_id", url, host.alias("host"), path.alias("p"), kind.alias("node_type"))
    first = F.element_at(F.split("host", r"\."), 1)
    of = lambda *kinds: F.col("node_type").isin(*kinds)
    label = F.when(of("file", "document"), F.regexp_extract("p", "([^/]*)/*$", 1)).when(of("symbol"), first).when(of("module"), F.col("host")).when(of("section"), F.concat(F.lit("About "), first)).otherwise(F.concat(F.lit("note "), F.col("page_id").cast("string")))
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    own = (
        F.when(of("file", "document"), F.array(entry("fullPath", F.col("p"))))
        .when(of("symbol"), F.array(entry("sourceFile", F.col("p")), entry("symbolKind", F.when(F.col("page_id") % 4 == 0, "class").otherwise("function"))))
        .when(of("module"), F.array(entry("importSource", F.concat("host", F.lit("/"), "p"))))
        .when(of("section"), F.array(entry("heading", F.col("label")), entry("sourceFile", F.col("p"))))
        .otherwise(F.array(entry("body", F.concat(F.lit("see "), "url")), entry("sourceFile", F.col("p")), entry("tag", F.lit("note"))))
    )
    rows = rows.withColumn("label", label).withColumn("metadata", F.map_from_entries(own))
    return rows.select(
        F.concat("node_type", F.lit(":"), "p", F.lit("#"), F.col("page_id").cast("string")).alias("id"), "label", "node_type", F.lit("repository").alias("source_type"),
        F.when(of("file", "document"), F.col("p")).otherwise(F.col("host")).alias("source_id"), "metadata", "page_id",
    )


PAGE_NODES_SQL = r"""
pg AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host, CASE WHEN page_id % 7 = 0 THEN 'build/' ELSE '' END || regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1) AS p,
  (['file','document','symbol','module','section','rationale'])[CAST(page_id % 6 + 1 AS INT)] AS kind FROM pages),
pl AS (SELECT *, CASE WHEN kind IN ('file', 'document') THEN regexp_extract(p, '([^/]*)/*$', 1) WHEN kind = 'symbol' THEN split_part(host, '.', 1) WHEN kind = 'module' THEN host
  WHEN kind = 'section' THEN 'About ' || split_part(host, '.', 1) ELSE 'note ' || page_id END AS label FROM pg),
pn AS (SELECT *, kind || ':' || p || '#' || page_id AS id, CASE WHEN kind IN ('file', 'document') THEN p ELSE host END AS source_id,
  CASE WHEN kind IN ('file', 'document') THEN p END AS full_path, CASE WHEN kind = 'symbol' THEN CASE WHEN page_id % 4 = 0 THEN 'class' ELSE 'function' END END AS symbol_kind,
  CASE WHEN kind = 'module' THEN host || '/' || p END AS import_source, CASE WHEN kind = 'section' THEN label END AS heading, CASE WHEN kind = 'rationale' THEN 'note' END AS tag,
  CASE WHEN kind = 'rationale' THEN 'see ' || url END AS body, CASE WHEN kind IN ('symbol', 'section', 'rationale') THEN p END AS source_file,
  CASE WHEN kind IN ('file', 'document') THEN '{"fullPath":"' || p || '"}' WHEN kind = 'symbol' THEN '{"sourceFile":"' || p || '","symbolKind":"' || CASE WHEN page_id % 4 = 0 THEN 'class' ELSE 'function' END || '"}'
    WHEN kind = 'module' THEN '{"importSource":"' || host || '/' || p || '"}' WHEN kind = 'section' THEN '{"heading":"' || label || '","sourceFile":"' || p || '"}'
    ELSE '{"body":"see ' || url || '","sourceFile":"' || p || '","tag":"note"}' END AS meta FROM pl)
"""
