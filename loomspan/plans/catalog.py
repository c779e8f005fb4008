"""Named queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import functools
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import text
from loomspan.operators import claims, cluster, components, context, events, graph, ranking, reconcile, relational, retrieval, traverse
from loomspan.plans.lineage import read, shared_folder
from loomspan.schemas import lookup
from loomspan.sources.adapters import CHAT_SQL, GRAPH_SQL, MEMORIES_SQL, PAGE_NODES_SQL, TELEMETRY_SQL, chat, memories, order_graph, page_nodes, telemetry
from loomspan.sources.vectors import VectorIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = datetime(2026, 1, 1)


def query(name: str, sql: str | None = None):
    def wrap(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return wrap


def six(x):
    return F.round(x, 6)


# --- H: derivation -----------------------------------------------------------

CLASS_SQL = """CASE WHEN event_type = 'error' OR exit_code <> 0 OR regexp_matches(lower(concat_ws(' | ', message, command, tool_name, file_path)), 'failed|error|exception') THEN 'debugging'
  WHEN event_type IN ('command', 'tool_call', 'tool_result', 'file_change') THEN 'implementation' ELSE 'conversation' END"""


@query("H01_event_text", f"WITH {TELEMETRY_SQL} SELECT event_id, concat_ws(' | ', message, command, tool_name, file_path) AS event_text FROM ev")
def h01(spark, sf):
    return telemetry(spark, sf).select("event_id", events.event_text().alias("event_text"))


@query("H05_event_class", f"WITH {TELEMETRY_SQL} SELECT event_id, {CLASS_SQL} AS event_class FROM ev")
def h05(spark, sf):
    return telemetry(spark, sf).select("event_id", events.event_class().alias("event_class"))


EPISODES_SQL = f"""
typed AS (SELECT *, {CLASS_SQL} AS t FROM ev),
marked AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR lag(t) OVER w <> t OR date_part('epoch', created_at - lag(created_at) OVER w) >= 86401 THEN 1 ELSE 0 END AS fresh
  FROM typed WINDOW w AS (PARTITION BY session_id ORDER BY created_at, ordinal)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY created_at, ordinal) AS run FROM marked),
nths AS (SELECT *, (row_number() OVER (PARTITION BY session_id, run ORDER BY created_at, ordinal) - 1) % 2 = 0 AS start FROM runs),
eps AS (SELECT *, count(*) FILTER (start) OVER (PARTITION BY session_id ORDER BY created_at, ordinal) AS episode FROM nths)
"""


@query("H06_event_episodes", f"WITH {TELEMETRY_SQL}, {EPISODES_SQL} SELECT event_id, session_id, t AS episode_type, episode FROM eps")
def h06(spark, sf):
    return events.episodes_of(telemetry(spark, sf), gap_seconds=86400, cap=2).select("event_id", "session_id", "episode_type", "episode")


@query("H07_episode_rollup", f"""WITH {TELEMETRY_SQL}, {EPISODES_SQL}
  SELECT session_id, episode, t AS episode_type, count(*) AS events, epoch_us(min(created_at)) AS started_us, epoch_us(max(created_at)) AS ended_us,
    string_agg(event_id, ',' ORDER BY created_at, ordinal) AS event_ids FROM eps GROUP BY ALL""")
def h07(spark, sf):
    e = events.materialise_episodes(events.episodes_of(telemetry(spark, sf), gap_seconds=86400, cap=2))
    return e.select("session_id", "episode", "episode_type", "events", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), F.array_join("provenance_event_ids", ",").alias("event_ids"))


SEGMENTS_SQL = """seg AS (SELECT doc_id, p, trim(regexp_replace(trim(s), '^[-*•]+|[-*•]+$', '', 'g')) AS s FROM (
    SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS p FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n|\\|| - '), lambda y: trim(y)), lambda y: octet_length(encode(y)) >= 12) AS x FROM documents))
  WHERE trim(regexp_replace(trim(s), '^[-*•]+|[-*•]+$', '', 'g')) <> '')"""
TYPE_SQL = """CASE WHEN regexp_matches(lower(s), 'open question:|question:|unknown whether') OR ends_with(lower(s), '?') THEN 'open_question'
  WHEN regexp_matches(lower(s), 'constraint:|must |do not |should not |required|fallback only') THEN 'constraint'
  WHEN regexp_matches(lower(s), 'decision:|decision update|we decided|policy:') THEN 'decision'
  WHEN regexp_matches(lower(s), 'task:|todo:|next:|follow up|need to |continue ') THEN 'task'
  WHEN regexp_matches(lower(s), 'fix:|fixed|resolved|verified fix|confirmed fix') THEN 'fix'
  WHEN regexp_matches(lower(s), 'failed|error|exception|bug:') THEN 'bug'
  WHEN regexp_matches(lower(s), 'verified|confirmed|current truth') THEN 'fact' END"""


@query("H08_claim_segments", f"WITH {SEGMENTS_SQL} SELECT doc_id, count(*) AS segments, sum(length(s))::BIGINT AS chars FROM seg GROUP BY doc_id")
def h08(spark, sf):
    s = read(spark, sf, "documents").select("doc_id", F.explode(claims.segments(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("segments"), F.sum(F.length("s")).alias("chars"))


@query("H09_claim_type", f"WITH {SEGMENTS_SQL} SELECT coalesce({TYPE_SQL}, 'none') AS claim_type, count(*) AS n FROM seg GROUP BY 1")
def h09(spark, sf):
    s = read(spark, sf, "documents").select(F.explode(claims.segments(F.col("text"))).alias("s"))
    kind = claims.claim_type(F.col("s"), F.lit(None).cast("string"), F.lit(None).cast("int"))
    return s.select(F.coalesce(kind, F.lit("none")).alias("claim_type")).groupBy("claim_type").agg(F.count("*").alias("n"))


GATE_SQL = """
g AS (SELECT event_id, event_type, s, kind, CASE WHEN event_type IN ('prompt', 'annotation') THEN 'user_confirmation' WHEN event_type IN ('tool_result', 'command', 'file_change') THEN 'tool_result'
    WHEN event_type IN ('test_result', 'error') THEN 'test_result' ELSE 'session_event' END AS proof FROM (
  SELECT event_id, event_type, concat_ws(' | ', message, command, tool_name, file_path) AS s,
    (['fact','decision','task','constraint','bug','fix','open_question','summary'])[CAST(ordinal % 8 + 1 AS INT)] AS kind FROM ev)),
a AS (SELECT *, CASE proof WHEN 'user_confirmation' THEN 'user_confirmed' WHEN 'tool_result' THEN 'tool_verified' WHEN 'test_result' THEN 'test_verified' ELSE 'session_derived' END AS authority,
  CASE proof WHEN 'user_confirmation' THEN 'user_confirmed' WHEN 'tool_result' THEN 'verified' WHEN 'test_result' THEN 'verified' ELSE 'inferred' END AS verification FROM g)
"""


@query("H13_belief_gate", f"""WITH {TELEMETRY_SQL}, {GATE_SQL}
  SELECT event_id, proof AS proof_type, authority, verification, CASE WHEN kind IN ('decision', 'constraint', 'task', 'open_question') THEN verification IN ('verified', 'user_confirmed')
    WHEN kind IN ('fact', 'bug', 'fix') THEN verification IN ('verified', 'user_confirmed') OR authority IN ('tool_verified', 'test_verified', 'user_confirmed') ELSE false END AS admitted FROM a""")
def h13(spark, sf):
    e = telemetry(spark, sf).withColumns({"s": events.event_text(), "kind": F.element_at(F.array(*map(F.lit, ("fact", "decision", "task", "constraint", "bug", "fix", "open_question", "summary"))), (F.col("ordinal") % 8 + 1).cast("int"))})
    t, s = F.col("event_type"), F.col("s")
    e = e.withColumns({"proof_type": claims.proof_type(t), "authority": claims.authority(t), "verification": claims.verification(s, t)})
    return e.select("event_id", "proof_type", "authority", "verification", claims.admitted(F.col("kind"), F.col("authority"), F.col("verification"), s, t).alias("admitted"))


@query("H14_polarity", f"WITH {MEMORIES_SQL} SELECT id, polarity FROM mem")
def h14(spark, sf):
    return memories(spark, sf).select("id", "polarity")


@query("H15_claim_key", f"WITH {MEMORIES_SQL} SELECT id, claim_key FROM mem")
def h15(spark, sf):
    return memories(spark, sf).select("id", "claim_key")


@query("H16_importance_confidence", f"""WITH {MEMORIES_SQL} SELECT id, round(CASE verification WHEN 'inferred' THEN greatest(b - 0.12, 0.2) WHEN 'unverified' THEN greatest(b - 0.25, 0.1) ELSE b END, 4)::DOUBLE AS importance,
    round(CASE verification WHEN 'verified' THEN 0.9 WHEN 'inferred' THEN 0.68 ELSE 0.2 END, 4)::DOUBLE AS confidence
  FROM (SELECT id, verification, CASE WHEN memory_type IN ('decision', 'constraint', 'fix') THEN 0.92 WHEN memory_type IN ('task', 'bug', 'fact') THEN 0.86 WHEN memory_type = 'open_question' THEN 0.7
    WHEN memory_type = 'implementation_detail' THEN 0.74 ELSE 0.45 END::DOUBLE AS b FROM mem)""")
def h16(spark, sf):
    m = memories(spark, sf)
    return m.select("id", claims.importance(F.col("memory_type"), F.col("verification")).alias("importance"), claims.confidence(F.col("verification"), F.lit(False)).alias("confidence"))


@query("H18_atomic_claims", f"""WITH {TELEMETRY_SQL}, s AS (SELECT session_id, event_id, event_type, exit_code, file_path, unnest(list_filter(list_transform(string_split(concat_ws(' | ', message, command, tool_name, file_path), '|'), lambda y: trim(y)), lambda y: octet_length(encode(y)) >= 12)) AS s FROM ev)
  SELECT CASE WHEN event_type = 'error' OR exit_code <> 0 OR regexp_matches(lower(s), 'failed|error|exception|bug:') THEN 'bug' ELSE 'implementation_detail' END AS claim_type, count(*) AS n
  FROM s WHERE event_type = 'error' OR exit_code <> 0 OR regexp_matches(lower(s), 'failed|error|exception|bug:') OR event_type IN ('command', 'tool_call', 'tool_result', 'file_change') GROUP BY 1""")
def h18(spark, sf):
    e = telemetry(spark, sf).select("event_type", "exit_code", F.explode(claims.segments(events.event_text())).alias("s"))
    kind = claims.claim_type(F.col("s"), F.col("event_type"), F.col("exit_code"))
    return e.select(kind.alias("claim_type")).where("claim_type is not null").groupBy("claim_type").agg(F.count("*").alias("n"))


@query("H20_reflections", f"""WITH {TELEMETRY_SQL}, {EPISODES_SQL}, ep AS (SELECT session_id, episode, any_value(t) AS t FROM eps GROUP BY 1, 2),
  r AS (SELECT session_id, count(*) AS n, count(*) FILTER (t = 'conversation') AS c, count(*) FILTER (t = 'implementation') AS i, count(*) FILTER (t = 'debugging') AS d, arg_max(t, episode) FILTER (t <> 'conversation') AS last_work FROM ep GROUP BY 1)
  SELECT session_id, CASE WHEN c >= i AND c >= d THEN 'conversation' WHEN i >= d THEN 'implementation' ELSE 'debugging' END AS dominant_type, coalesce(last_work = 'debugging', false) AS unresolved_risk FROM r WHERE n >= 2""")
def h20(spark, sf):
    e = events.materialise_episodes(events.episodes_of(telemetry(spark, sf), gap_seconds=86400, cap=2))
    return claims.reflections(e).select("session_id", "dominant_type", "unresolved_risk")


@query("H21_error_signature", r"SELECT page_id, left(trim(regexp_replace(regexp_replace(lower(html), '[0-9a-f]{7,}', '', 'g'), '\s+', ' ', 'g')), 160) AS signature FROM pages")
def h21(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.error_signature(F.col("html")).alias("signature"))


SIGNALS_SQL = """sig AS (SELECT session_id, list_sort(list_distinct(list(file_path) FILTER (file_path IS NOT NULL))) AS files,
  list_sort(list_distinct(list(left(trim(regexp_replace(regexp_replace(lower(concat_ws(' | ', message, command, tool_name, file_path)), '[0-9a-f]{7,}', '', 'g'), '\\s+', ' ', 'g')), 160)) FILTER (event_type = 'error' OR exit_code <> 0))) AS errors FROM ev GROUP BY 1)"""


@query("D16_session_signals", f"WITH {TELEMETRY_SQL}, {SIGNALS_SQL} SELECT session_id, coalesce(len(files), 0)::INT AS n_files, coalesce(len(errors), 0)::INT AS n_errors FROM sig")
def d16(spark, sf):
    return events.session_signals(telemetry(spark, sf)).select("session_id", F.size("files").alias("n_files"), F.size("errors").alias("n_errors"))


@query("H22_session_edges", f"""WITH {TELEMETRY_SQL}, {SIGNALS_SQL}, s AS (SELECT *, 'p' || (CAST(session_id AS INT) % 4) AS project, 'b' || (CAST(session_id AS INT) % 5) AS branch, row_number() OVER (PARTITION BY CAST(session_id AS INT) % 4 ORDER BY session_id) AS n FROM sig),
  x AS (SELECT least(a.session_id, b.session_id) AS source, greatest(a.session_id, b.session_id) AS target, a.branch = b.branch AS same, len(list_intersect(a.files, b.files)) AS f, len(list_intersect(a.errors, b.errors)) AS e
    FROM s a JOIN s b ON a.project = b.project AND b.n < a.n AND b.n >= a.n - 20),
  w AS (SELECT *, CASE WHEN same THEN 0.35 ELSE 0 END + least(0.3, 0.15 * coalesce(f, 0)) + least(0.3, 0.15 * coalesce(e, 0)) AS w FROM x)
  SELECT source, target, CASE WHEN same THEN 'same_branch' ELSE 'related_to' END AS relation, round(w, 4)::DOUBLE AS weight FROM w WHERE round(w, 9) >= 0.35""")
def h22(spark, sf):
    s = events.session_signals(telemetry(spark, sf)).withColumns({"project_id": F.concat(F.lit("p"), (F.col("session_id").cast("int") % 4).cast("string")), "branch": F.concat(F.lit("b"), (F.col("session_id").cast("int") % 5).cast("string")), "ended_at": F.lit(0)})
    return events.session_edges(s).select("source", "target", "relation", "weight")


@query("H25_page_headings_class", r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1)) AS t FROM pages)
  SELECT page_id, count(*) AS headings, sum(length(t))::BIGINT AS chars FROM h GROUP BY 1""")
def h25(spark, sf):
    h = read(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<h[1-6][^>]*>([^<]*)</h[1-6]>"), F.lit(1))).alias("t"))
    return h.groupBy("page_id").agg(F.count("*").alias("headings"), F.sum(F.length("t")).alias("chars"))


@query("N04_turn_ids", f"WITH {CHAT_SQL}, m AS (SELECT *, bool_or(event_type = 'turn_context') OVER (PARTITION BY session_id) AS has FROM chat) SELECT session_id, ordinal, count(*) FILTER (event_type = CASE WHEN has THEN 'turn_context' ELSE 'prompt' END) OVER (PARTITION BY session_id ORDER BY ordinal) AS turn FROM m")
def n04(spark, sf):
    return events.turn_ids(chat(spark, sf)).select("session_id", "ordinal", "turn")


@query("N05_session_window", "WITH m AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 15 MINUTE THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM m) SELECT user_id, epoch_us(min(ts)) AS started_us, count(*) AS n FROM r GROUP BY user_id, s")
def n05(spark, sf):
    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "15 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("started_us"), "n")


# --- B, C: predicates and joins ------------------------------------------------

CURRENT_SQL = "admitted AND superseded_by IS NULL AND valid_to IS NULL AND verification <> 'contradicted' AND governance NOT IN ('archived', 'rejected')"


@query("B03_current_claims", f"WITH {MEMORIES_SQL} SELECT id, memory_type FROM mem WHERE {CURRENT_SQL}")
def b03(spark, sf):
    return memories(spark, sf).where(claims.is_current()).select("id", "memory_type")


@query("B01_optional_predicates", f"WITH {MEMORIES_SQL} SELECT id FROM mem WHERE project_id = 'src1' AND memory_type IN ('fact', 'bug') AND created_s >= 1767225600 - 36000 * 500")
def b01(spark, sf):
    since = datetime.fromtimestamp(1767225600 - 36000 * 500).astimezone()
    return relational.filtered(memories(spark, sf), {"project_id": "src1", "branch": None}, {"memory_type": ("fact", "bug"), "authority": ()}, "created_at", since, None).select("id")


@query("B06_contains_escaped", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the%th') OR contains(lower(source), 'c1')")
def b06(spark, sf):
    d = read(spark, sf, "documents")
    return d.where(relational.ilike_any(["text"], "the%th") | relational.ilike_any(["source"], "C1")).select("doc_id")


@query("B11_claim_subject", f"WITH {MEMORIES_SQL} SELECT id, coalesce(nullif(split_part(claim_key, ':', 2), ''), 'global') AS subject FROM mem")
def b11(spark, sf):
    return memories(spark, sf).select("id", claims.claim_subject(F.col("claim_key"), F.lit(None).cast("string")).alias("subject"))


@query("B24_truth_claims", f"WITH {MEMORIES_SQL} SELECT id FROM mem WHERE verification IN ('verified', 'user_confirmed') OR authority IN ('repository', 'tool_verified', 'test_verified', 'user_confirmed')")
def b24(spark, sf):
    return memories(spark, sf).where(claims.is_truth(F.col("verification"), F.col("authority"))).select("id")


@query("C01_left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def c01(spark, sf):
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey")


@query("C02_top1_claim", "SELECT c_custkey, o.o_orderkey, o.o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) o ON o_custkey = c_custkey")
def c02(spark, sf):
    top = relational.top_per_key(read(spark, sf, "orders"), ["o_custkey"], [F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")], 1)
    c = read(spark, sf, "customer")
    return c.join(top, c.c_custkey == top.o_custkey, "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query("C03_conflict_count", "WITH e AS (SELECT user_id AS a, CAST(event_id % 97 AS BIGINT) AS b FROM events WHERE event_type = 'error'), x AS (SELECT a AS id FROM e UNION ALL SELECT b FROM e WHERE a <> b) SELECT id, count(*) AS conflicts FROM x GROUP BY 1")
def c03(spark, sf):
    e = read(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("a"), (F.col("event_id") % 97).alias("b"))
    return relational.either_end_counts(e, "a", "b").withColumnRenamed("n", "conflicts")


@query("C04_other_endpoint", "WITH e AS (SELECT c_custkey AS a, (c_custkey * 7 + 3) % 1000 AS b FROM customer) SELECT a AS id, b AS other, 'out' AS direction FROM e WHERE a IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT b, a, 'in' FROM e WHERE b IN (SELECT s_suppkey FROM supplier)")
def c04(spark, sf):
    e = read(spark, sf, "customer").select(F.col("c_custkey").alias("a"), ((F.col("c_custkey") * 7 + 3) % 1000).alias("b"))
    return relational.other_ends(e, "a", "b", read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")))


@query("C05_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def c05(spark, sf):
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders").where("o_totalprice > 400000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("C06_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def c06(spark, sf):
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders").where("o_totalprice > 400000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("C08_two_key_lookup", "SELECT e.event_id, coalesce(x.o_orderkey, y.o_orderkey) AS found FROM events e LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) x ON x.o_custkey = e.user_id LEFT JOIN orders y ON y.o_orderkey = e.event_id")
def c08(spark, sf):
    e, o = read(spark, sf, "events").select("event_id", "user_id"), read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return relational.two_key_lookup(e, o, ("user_id", "o_custkey"), ("event_id", "o_orderkey"), "o_orderkey").select("event_id", F.col("o_orderkey").alias("found"))


CANDIDATES_SQL = f"""WITH {MEMORIES_SQL}, x AS (SELECT a.id, b.id AS prior, b.created_s, a.memory_type AS kind, b.memory_type AS prior_kind, a.polarity AS pol, b.polarity AS prior_pol,
    a.authority AS au, b.authority AS prior_au, a.verification AS ve, b.verification AS prior_ve
  FROM mem a JOIN mem b ON a.project_id = b.project_id AND a.id <> b.id AND b.admitted AND (a.claim_key = b.claim_key OR a.subject = b.subject)),
cand AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_s DESC, CAST(prior AS VARCHAR) DESC) AS rank FROM x QUALIFY rank <= 12)"""
STRENGTH = lambda a, v: f"(CASE {a} WHEN 'repository' THEN 50 WHEN 'test_verified' THEN 45 WHEN 'tool_verified' THEN 40 WHEN 'user_confirmed' THEN 35 WHEN 'session_derived' THEN 20 ELSE 0 END + CASE {v} WHEN 'verified' THEN 4 WHEN 'inferred' THEN 2 ELSE 1 END)"


def _claims(spark, sf):
    return memories(spark, sf).withColumn("claim_type", F.col("memory_type"))


def _candidates(spark, sf):
    c = _claims(spark, sf)
    return reconcile.prior_candidates(c.select("claim_id", "project_id", "claim_key", "subject", "claim_type", "polarity", "authority", "verification"), c)


@query("C15_prior_candidates", f"{CANDIDATES_SQL} SELECT CAST(id AS VARCHAR) AS claim_id, CAST(prior AS VARCHAR) AS prior_claim_id, rank FROM cand")
def c15(spark, sf):
    return _candidates(spark, sf).select("claim_id", "prior_claim_id", F.col("rank").cast("long").alias("rank"))


@query("I01_claim_strength", f"WITH {MEMORIES_SQL} SELECT id, {STRENGTH('authority', 'verification')} AS strength FROM mem")
def i01(spark, sf):
    return memories(spark, sf).select("id", reconcile.strength(F.col("authority"), F.col("verification")).alias("strength"))


EDGE_SQL = f"""{CANDIDATES_SQL}, s AS (SELECT *, {STRENGTH('au', 've')} AS mine, {STRENGTH('prior_au', 'prior_ve')} AS other FROM cand)
  SELECT CAST(id AS VARCHAR) AS claim_id, CAST(prior AS VARCHAR) AS prior_claim_id, 'supersedes' AS relation, 0.9::DOUBLE AS weight FROM s
    WHERE mine >= other AND ((kind = prior_kind AND kind IN ('decision', 'constraint', 'fact', 'task')) OR (kind = 'fix' AND prior_kind = 'bug') OR (kind = 'constraint' AND prior_kind = 'decision'))
  UNION ALL SELECT CAST(id AS VARCHAR), CAST(prior AS VARCHAR), CASE WHEN pol <> prior_pol THEN 'contradicts' ELSE 'confirms' END, CASE WHEN pol <> prior_pol THEN 0.86 ELSE 0.62 END FROM s"""


@query("I03_reconcile_edges", EDGE_SQL)
def i03(spark, sf):
    return reconcile.reconcile_edges(_candidates(spark, sf)).select("claim_id", "prior_claim_id", "relation", "weight")


@query("I02_supersede_pairs", f"SELECT claim_id, prior_claim_id FROM ({EDGE_SQL}) WHERE relation = 'supersedes'")
def i02(spark, sf):
    return reconcile.reconcile_edges(_candidates(spark, sf)).where("relation = 'supersedes'").select("claim_id", "prior_claim_id")


@query("D23_reconcile_outcome", f"SELECT count(*) FILTER (relation = 'supersedes') AS supersedes, count(*) FILTER (relation = 'contradicts') AS contradicts, count(*) FILTER (relation = 'confirms') AS confirms FROM ({EDGE_SQL})")
def d23(spark, sf):
    return reconcile.outcome(reconcile.reconcile_edges(_candidates(spark, sf))).drop("contradicted")


@query("I04_reconcile_in_order")
def i04(spark, sf):
    return reconcile.reconcile_in_order(_claims(spark, sf))


# --- D: aggregations -----------------------------------------------------------


@query("D01_queue_summary", "SELECT count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'P') AS running, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) AS total FROM orders")
def d01(spark, sf):
    return relational.queue_summary(read(spark, sf, "orders"), "o_orderstatus", {"O": "pending", "P": "running", "F": "completed"})


@query("D02_token_savings", "SELECT count(*) AS memories, sum(greatest(length(text) - length(left(text, 300)), 0) // 4)::BIGINT AS saved FROM documents")
def d02(spark, sf):
    return relational.token_savings(read(spark, sf, "documents").withColumn("summary", F.left("text", F.lit(300))), "text", "summary")


@query("D03_queue_matrix", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, epoch(min(o_orderdate))::BIGINT AS oldest, epoch(max(o_orderdate))::BIGINT AS newest FROM orders GROUP BY 1, 2")
def d03(spark, sf):
    o = read(spark, sf, "orders").withColumn("at", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")))
    return o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.min("at").alias("oldest"), F.max("at").alias("newest"))


@query("D04_counts_per_parent", "SELECT c_custkey, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def d04(spark, sf):
    return relational.counts_per_parent(read(spark, sf, "customer"), read(spark, sf, "orders"), "c_custkey", "o_custkey", "orders").select("c_custkey", "orders")


@query("D06_max_score", "SELECT o_custkey, max(o_totalprice) AS best FROM orders GROUP BY 1")
def d06(spark, sf):
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"))


@query("D08_graph_stats", f"WITH {GRAPH_SQL} SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM edges WHERE evidence = 'extracted') AS extracted, (SELECT count(*) FROM edges WHERE evidence = 'inferred') AS inferred, (SELECT count(*) FROM edges WHERE evidence = 'ambiguous') AS ambiguous, round((SELECT sum(degree) FROM degree) / (SELECT count(*) FROM nodes), 2)::DOUBLE AS avg_degree, round((SELECT count(*) FROM edges) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1) / 2.0), 4)::DOUBLE AS density, (SELECT count(*) FROM degree WHERE degree = 0) AS isolated_nodes")
def d08(spark, sf):
    return graph.statistics(*order_graph(spark, sf)).drop("community_count")


@query("D09_degrees", f"WITH {GRAPH_SQL} SELECT id, in_degree, out_degree, degree FROM degree")
def d09(spark, sf):
    return graph.degrees(*order_graph(spark, sf))


@query("D10_type_histogram", f"WITH {GRAPH_SQL} SELECT node_type, count(*) AS n FROM nodes GROUP BY 1")
def d10(spark, sf):
    return order_graph(spark, sf)[0].groupBy("node_type").agg(F.count("*").alias("n"))


@query("D13_p95_degree", f"WITH {GRAPH_SQL} SELECT degree AS p95_degree FROM (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i FROM degree) WHERE i = (SELECT floor(count(*) * 0.95)::BIGINT FROM degree)")
def d13(spark, sf):
    return graph.p95_degree(*order_graph(spark, sf))


@query("D14_most_modified", f"WITH {TELEMETRY_SQL} SELECT file_path, count(*) AS n FROM ev WHERE event_type = 'file_change' GROUP BY 1 ORDER BY n DESC, file_path LIMIT 10")
def d14(spark, sf):
    return telemetry(spark, sf).where("event_type = 'file_change'").groupBy("file_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_path").limit(10)


@query("D19_related_map", f"WITH {GRAPH_SQL}, b AS (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges) SELECT a AS id, string_agg(DISTINCT b, ',' ORDER BY b) AS related FROM b GROUP BY 1")
def d19(spark, sf):
    _, e = order_graph(spark, sf)
    return graph.both_ways(e).groupBy(F.col("a").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("b")), ",").alias("related"))


@query("D22_latency_percentiles", "WITH r AS (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events) SELECT max(value) FILTER (i = greatest(1, ceil(n * 0.5))) AS p50, max(value) FILTER (i = greatest(1, ceil(n * 0.95))) AS p95, max(value) FILTER (i = greatest(1, ceil(n * 0.99))) AS p99, max(value) AS worst, round(avg(value), 6) AS mean FROM r")
def d22(spark, sf):
    return relational.nearest_ranks(read(spark, sf, "events"), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


# --- E: retrieval ----------------------------------------------------------------


@query("E05_hash_embedding_dims", "WITH t AS (SELECT page_id, unnest(regexp_extract_all(lower(url), '[a-z0-9_]+')) AS t FROM pages), h AS (SELECT page_id, list_reduce(list_transform(string_split(t, ''), lambda c: ascii(c)::BIGINT), lambda h, x: (xor(h, x) * 16777619) & 4294967295, 2166136261::BIGINT) AS h FROM t) SELECT page_id, (h % 1536)::INT AS dim, sum(CASE WHEN (h >> 31) = 1 THEN -1.0 ELSE 1.0 END)::DOUBLE AS weight FROM h GROUP BY 1, 2")
def e05(spark, sf):
    t = read(spark, sf, "pages").select("page_id", F.explode(text.embedding_terms(F.col("url"))).alias("t"))
    return t.groupBy("page_id", F.col("t.dim").alias("dim")).agg(F.sum("t.sign").alias("weight"))


def _vector(spark, sf) -> list[float]:
    return list(read(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"])


COSINE_SQL = "round(greatest(0, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6)"


@query("E08_cosine_topk", f"SELECT e.vec_id, {COSINE_SQL} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 10")
def e08(spark, sf):
    return retrieval.nearest(read(spark, sf, "embeddings"), _vector(spark, sf), 10, "vec_id").select("vec_id", six(F.col("similarity")).alias("similarity"))


@query("E09_typed_topk", f"WITH s AS (SELECT e.vec_id, e.label, {COSINE_SQL} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label IN (1, 3, 99)) SELECT vec_id, label, similarity FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) <= 5 ORDER BY similarity DESC, vec_id LIMIT 5")
def e09(spark, sf):
    return retrieval.nearest_typed(read(spark, sf, "embeddings"), _vector(spark, sf), 5, [1, 3, 99], "vec_id", "label").select("vec_id", "label", six(F.col("similarity")).alias("similarity"))


NEAREST_SQL = "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(greatest(0, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS similarity, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS raw FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) SELECT query_id, vec_id, similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, vec_id) <= 3"


@query("E07_batch_nearest", NEAREST_SQL)
def e07(spark, sf):
    e = read(spark, sf, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.batch_nearest(e, q, 3, "vec_id").select("query_id", "vec_id", six(F.col("similarity")).alias("similarity"))


@query("E10_cell_search", NEAREST_SQL)
def e10_cells(spark, sf):
    """An index by cells is written beside the checkpoints; the few nearest cells, then those whose bounds leave a chance."""
    e = read(spark, sf, "embeddings")
    index = VectorIndex(spark, shared_folder(spark, "vectors"), "vec_id")
    index.build(e)
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return index.search(q, 3, probes=4, exact=True).select("query_id", "vec_id", six(F.col("similarity")).alias("similarity"))



@query("E15_hybrid_merge", "WITH l AS (SELECT doc_id AS id, (doc_id % 9) / 9.0::DOUBLE AS s FROM documents), v AS (SELECT vec_id AS id, (label + 1) / 10.0::DOUBLE AS d FROM embeddings) SELECT coalesce(l.id, v.id) AS id, round(greatest(coalesce(s, 0), coalesce(1.0 / (1.0 + d), 0)), 6)::DOUBLE AS score FROM l FULL JOIN v ON l.id = v.id")
def e15(spark, sf):
    lexical = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), ((F.col("doc_id") % 9) / 9.0).alias("score"))
    near = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), ((F.col("label") + 1) / 10.0).alias("distance"))
    return ranking.merge_hybrid(lexical, near).select("id", six(F.col("score")).alias("score"))


RANK_SQL = f"""{MEMORIES_SQL},
r AS (SELECT *, (1767225600 - created_s) / 86400.0 AS days, CASE WHEN contains(lower(title), 'session reflection') THEN 'reflection' WHEN memory_type = 'summary' AND (starts_with(lower(title), 'session summary') OR starts_with(lower(title), 'episode ') OR regexp_matches(lower(title), ': (debugging|conversation|implementation) -')) THEN 'session_summary' ELSE memory_type END AS source_class FROM mem),
g AS (SELECT *, CASE WHEN days <= 1 THEN 1.0 WHEN days <= 7 THEN 0.85 WHEN days <= 30 THEN 0.65 WHEN days <= 90 THEN 0.4 ELSE 0.2 END::DOUBLE AS recency,
  CASE WHEN memory_type IN ('task', 'implementation_detail', 'open_question') THEN CASE WHEN days > 14 THEN 0.5 ELSE 0 END WHEN memory_type IN ('bug', 'fix') THEN CASE WHEN days > 30 THEN 0.3 ELSE 0 END
    WHEN memory_type IN ('decision', 'fact', 'constraint') THEN CASE WHEN days > 180 THEN 0.1 ELSE 0 END ELSE CASE WHEN days > 90 THEN 0.2 ELSE 0 END END::DOUBLE AS staleness FROM r),
f AS (SELECT *, lexical_score * 0.32 + semantic_score * 0.30 + CASE WHEN session_ids[1] = '3' THEN 1.0 WHEN branch = 'b1' THEN 0.45 ELSE 0 END * 0.12 + graph_proximity * 0.10 + recency * 0.08 + importance * 0.08 + confidence * 0.06
  + CASE source_class WHEN 'decision' THEN 0.22 WHEN 'fact' THEN 0.22 WHEN 'task' THEN 0.18 WHEN 'constraint' THEN 0.2 WHEN 'implementation_detail' THEN 0.14 WHEN 'bug' THEN 0.12 WHEN 'fix' THEN 0.18 WHEN 'open_question' THEN 0.1 WHEN 'risk' THEN 0.08 WHEN 'summary' THEN -0.08 WHEN 'reflection' THEN -0.24 WHEN 'session_summary' THEN -0.18 ELSE 0 END
  + CASE authority WHEN 'repository' THEN 0.18 WHEN 'test_verified' THEN 0.15 WHEN 'tool_verified' THEN 0.12 WHEN 'user_confirmed' THEN 0.10 WHEN 'session_derived' THEN 0.04 ELSE 0 END
  + CASE verification WHEN 'verified' THEN 0.10 WHEN 'inferred' THEN 0.02 ELSE 0 END + CASE WHEN source_class IN ('fact', 'decision') THEN 0.25 ELSE -0.15 END + community_score * 0.15
  + CASE governance WHEN 'pinned' THEN 0.20 WHEN 'rejected' THEN -0.80 ELSE 0 END
  + CASE WHEN superseded_by IS NOT NULL THEN -0.20 WHEN memory_type IN ('task', 'decision', 'constraint', 'open_question', 'fix') THEN CASE WHEN recency >= 0.65 THEN 0.30 ELSE 0.15 END WHEN recency >= 0.65 THEN 0.05 ELSE 0 END
  - staleness * 0.10 - CASE WHEN superseded_by IS NOT NULL THEN 0.10 ELSE 0 END - least(0.24, conflicts * 0.08) + CASE WHEN session_ids[1] = '3' THEN 0.5 ELSE 0 END AS final_score FROM g)"""
REQUEST = ranking.Request(query="what is open", now=NOW, session_id="3", branch="b1", types=("fact", "decision"), continuation=True)


@query("E16_fused_score", f"WITH {RANK_SQL} SELECT id, source_class, round(final_score, 6)::DOUBLE AS final_score FROM f")
def e16(spark, sf):
    return ranking.fuse(memories(spark, sf), REQUEST).select("id", "source_class", six(F.col("final_score")).alias("final_score"))


@query("E28_recency_staleness", f"WITH {RANK_SQL} SELECT id, recency, staleness FROM g")
def e28(spark, sf):
    now = F.lit(NOW)
    m = memories(spark, sf)
    return m.select("id", ranking.recency(F.col("created_at"), now).alias("recency"), ranking.staleness(F.col("memory_type"), F.col("created_at"), now, F.col("superseded_at")).alias("staleness"))


CANON = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z_]+', ' ', 'g'))"


@query("E31_diversify", f"WITH {RANK_SQL}, d AS (SELECT *, coalesce(nullif({CANON('title')}, ''), {CANON('summary')}) AS fam FROM f QUALIFY row_number() OVER (PARTITION BY source_class, coalesce(nullif({CANON('title')}, ''), {CANON('summary')}) ORDER BY round(final_score, 9) DESC, created_s DESC, id) = 1) SELECT id FROM d QUALIFY CASE WHEN source_class IN ('session_summary', 'reflection', 'summary') THEN row_number() OVER (PARTITION BY source_class IN ('session_summary', 'reflection', 'summary'), session_ids[1] ORDER BY round(final_score, 9) DESC, created_s DESC, id) ELSE 1 END = 1")
def e31(spark, sf):
    order = (F.desc(F.round("final_score", 9)), F.desc("created_at"), F.asc("id"))
    return ranking.diversify(ranking.fuse(memories(spark, sf), REQUEST), order).select("id")


@query("E39_goal_overlap", "WITH g AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_./:+-]+'), lambda t: length(t) >= 3 AND NOT list_contains(['the','and','for','with','from','that','this','what','which','who','how','why','was','were','has','have','had','are','can','all','any','but','not','our','your','his','her','its','ours'], t))) AS goals FROM benchmark), d AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT item_id, doc_id, CASE WHEN len(goals) > 0 THEN round(len(list_filter(goals, lambda x: contains(t, x))) / len(goals), 6) ELSE 0 END::DOUBLE AS share FROM g JOIN d ON item_id = doc_id")
def e39(spark, sf):
    g = read(spark, sf, "benchmark").select("item_id", text.sub_goals(F.col("text")).alias("goals"))
    d = read(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"))
    return g.join(d, F.col("item_id") == F.col("doc_id")).select("item_id", "doc_id", six(retrieval.goal_share(F.col("goals"), F.col("t"))).alias("share"))


@query("E03_text_match", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(quequ|queque|queques|quequed|quequing)($|[^\p{L}\p{N}_])')")
def e03(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("title"), F.lit("").alias("summary"), F.col("text").alias("content"))
    return retrieval.match(d, "queque").select(F.col("id").alias("doc_id"))


@query("E42_hybrid_search")
def e42(spark, sf):
    from loomspan.plans.search import hybrid_search

    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return hybrid_search(memories(spark, sf).drop("lexical_score", "semantic_score"), ranking.Request(query="that or with or queque or eine", now=NOW), 12, _vector(spark, sf), vectors).select("id", "rank", "level", six(F.col("final_score")).alias("final_score"))


# --- F: windows, paging ---------------------------------------------------------------


@query("F01_top2_per_group", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 2")
def f01(spark, sf):
    return relational.top_per_key(read(spark, sf, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], 2).select("user_id", "event_id")


@query("F02_latest_per_key", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
def f02(spark, sf):
    return relational.latest(read(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("F04_keyset_page", "SELECT o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1998-01-01', 7000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 26")
def f04(spark, sf):
    return relational.keyset_page(read(spark, sf, "orders"), "o_orderdate", "o_orderkey", (datetime(1998, 1, 1), 7000), 25).select("o_orderkey")


@query("F06_lag_changes", "SELECT event_id, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS changed FROM events")
def f06(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf, "events").select("event_id", (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))).alias("changed"))


@query("F12_next_job", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1")
def f12(spark, sf):
    return read(spark, sf, "orders").where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").select("o_orderkey").limit(1)


@query("F14_round_robin", f"WITH {GRAPH_SQL} SELECT id, row_number() OVER (PARTITION BY node_type ORDER BY degree DESC, id) AS turn FROM degree")
def f14(spark, sf):
    n, e = order_graph(spark, sf)
    return graph.interleave(n.join(graph.degrees(n, e).select("id", "degree"), "id")).select("id", F.col("turn").cast("long").alias("turn"))


F15_SQL = f"""WITH {GRAPH_SQL}, r AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM nodes ORDER BY id), seeds AS (SELECT * FROM r WHERE n <= 33), en AS (SELECT source, target, row_number() OVER (ORDER BY source, target, relation) AS e FROM edges),
  near AS (SELECT t AS id, min(struct_pack(a := s.n, b := e)) AS k FROM (SELECT source AS f, target AS t, e FROM en UNION ALL SELECT target, source, e FROM en) x JOIN seeds s ON s.id = x.f GROUP BY 1),
  placed AS (SELECT r.id, CASE WHEN s.id IS NOT NULL THEN 0 WHEN near.id IS NOT NULL THEN 1 ELSE 2 END AS tier, r.n, near.k FROM r LEFT JOIN seeds s ON s.id = r.id LEFT JOIN near ON near.id = r.id)
  SELECT id FROM placed ORDER BY tier, CASE WHEN tier = 1 THEN k.a ELSE n END, CASE WHEN tier = 1 THEN k.b END LIMIT 100"""


@query("F15_display_projection", F15_SQL)
def f15(spark, sf):
    return graph.project_for_display(*order_graph(spark, sf), 100, 150)[0].select("id")


# --- G: sets, upserts ---------------------------------------------------------------


@query("G01_idempotent_append", "WITH s AS (SELECT * FROM events WHERE event_id % 3 = 0), b AS (SELECT event_id, user_id, event_id % 500 AS k FROM events) SELECT event_id, (b.k IN (SELECT event_id % 500 FROM s WHERE s.user_id = b.user_id)) OR row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) > 1 AS duplicate FROM b")
def g01(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").cast("string").alias("event_id"), (F.col("event_id") % 500).cast("string").alias("idempotency_key"), F.col("event_id").alias("position"))
    stored = e.where("position % 3 = 0").withColumn("event_id", F.concat(F.lit("x"), "event_id"))
    return events.append_once(stored, e).select(F.col("position").alias("event_id"), "duplicate")


@query("G02_upsert_latest", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def g02(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("version"))
    fresh = o.where("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit(2).alias("version"))
    return relational.upsert(o, fresh, ["o_orderkey"], ["version"]).select("o_orderkey", "o_totalprice")


@query("G03_replace_children", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey >= 1000 UNION ALL SELECT DISTINCT l_orderkey, 0, l_partkey FROM lineitem WHERE l_orderkey < 1000)")
def g03(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    fresh = rows.where("l_orderkey < 1000").withColumn("l_linenumber", F.lit(0))
    return relational.replace_children(rows, fresh, "l_orderkey", ["l_orderkey", "l_linenumber", "l_partkey"])


@query("G04_enqueue_least", "SELECT o_custkey, min(o_orderpriority) AS priority, epoch(min(o_orderdate))::BIGINT AS available FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1")
def g04(spark, sf):
    o = read(spark, sf, "orders").where("o_orderstatus in ('O', 'P')")
    return o.groupBy("o_custkey").agg(F.min("o_orderpriority").alias("priority"), F.unix_timestamp(F.min("o_orderdate").cast("timestamp")).alias("available"))


@query("G09_first_draft", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY event_id) = 1")
def g09(spark, sf):
    e = read(spark, sf, "events").withColumn("day", F.date_trunc("day", "ts"))
    return relational.top_per_key(e, ["user_id", "event_type", "day"], [F.asc("event_id")], 1).select("event_id")


@query("G11_edge_merge", f"WITH {GRAPH_SQL}, e AS (SELECT source, target, 'rel' AS relation, evidence, weight, 1 AS p FROM edges UNION ALL SELECT source, target, 'rel', CASE WHEN length(target) % 2 = 0 THEN 'extracted' ELSE 'ambiguous' END, 0.75, 2 FROM edges) SELECT source, target, relation, arg_max(evidence, CASE evidence WHEN 'extracted' THEN 30 WHEN 'inferred' THEN 20 ELSE 10 END - p) AS evidence, max(weight) AS weight FROM e GROUP BY 1, 2, 3")
def g11(spark, sf):
    _, e = order_graph(spark, sf)
    first = e.withColumns({"relation": F.lit("rel"), "position": F.lit(1)})
    second = first.withColumns({"evidence": F.when(F.length("target") % 2 == 0, "extracted").otherwise("ambiguous"), "weight": F.lit(0.75), "position": F.lit(2)})
    return graph.merge_edges(first.unionByName(second))


@query("G15_set_intersections", f"WITH {TELEMETRY_SQL}, {SIGNALS_SQL} SELECT a.session_id, coalesce(len(list_intersect(a.files, b.files)), 0)::INT AS shared FROM sig a JOIN sig b ON CAST(b.session_id AS INT) = CAST(a.session_id AS INT) + 1")
def g15(spark, sf):
    s = events.session_signals(telemetry(spark, sf))
    b = s.select((F.col("session_id").cast("int") - 1).alias("k"), F.col("files").alias("other"))
    return s.join(b, s.session_id.cast("int") == b.k).select("session_id", F.size(F.array_intersect("files", "other")).alias("shared"))


@query("G16_manifest_diff", "WITH a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 10 <> 1), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE md5(text) END AS h FROM documents WHERE doc_id % 10 <> 2) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h")
def g16(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    return relational.manifest_diff(d.where("doc_id % 10 <> 1"), d.where("doc_id % 10 <> 2").withColumn("h", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("h"))), "doc_id", "h")


# --- J, K: graphs -----------------------------------------------------------------


@query("J01_structural_edges", f"""WITH {TELEMETRY_SQL}, rest AS (SELECT * FROM ev WHERE event_type NOT IN ('file_change', 'test_result'))
  SELECT relation, count(*) AS n, count(DISTINCT source || '>' || target) AS pairs FROM (
    SELECT 'session:' || session_id AS source, 'file:' || file_path AS target, 'modifies' AS relation FROM ev WHERE event_type = 'file_change'
    UNION ALL SELECT 'file:' || file_path, 'session:' || session_id, 'touched_by' FROM ev WHERE event_type = 'file_change'
    UNION ALL SELECT 'session:' || session_id, 'test:' || event_id, 'produces' FROM ev WHERE event_type = 'test_result'
    UNION ALL SELECT 'session:' || session_id, 'tool:' || tool_name, CASE WHEN event_type = 'tool_call' THEN 'calls' ELSE 'produces' END FROM rest WHERE tool_name IS NOT NULL
    UNION ALL SELECT 'session:' || session_id, 'cmd:' || 'run step' || regexp_extract(command, 'step([0-9])', 1) || ' now', 'calls' FROM rest WHERE command IS NOT NULL
    UNION ALL SELECT 'error:' || left(trim(regexp_replace(regexp_replace(lower(concat_ws(' | ', message, command, tool_name, file_path)), '[0-9a-f]{{7,}}', '', 'g'), '\\s+', '_', 'g')), 80), 'session:' || session_id, 'caused_by' FROM rest WHERE event_type = 'error'
    UNION ALL SELECT 'error:' || left(trim(regexp_replace(regexp_replace(lower(concat_ws(' | ', message, command, tool_name, file_path)), '[0-9a-f]{{7,}}', '', 'g'), '\\s+', '_', 'g')), 80), 'file:' || file_path, 'references' FROM rest WHERE event_type = 'error') GROUP BY 1""")
def j01(spark, sf):
    _, e = graph.structural_graph(telemetry(spark, sf))
    return e.groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct(F.concat("source", F.lit(">"), "target")).alias("pairs"))


@query("J02_co_occurrence", f"WITH {TELEMETRY_SQL}, s AS (SELECT session_id, file_path, min(struct_pack(a := created_at, b := ordinal)) AS at FROM ev WHERE event_type = 'file_change' GROUP BY 1, 2) SELECT a.session_id, a.file_path AS source, b.file_path AS target FROM s a JOIN s b ON a.session_id = b.session_id AND a.at < b.at")
def j02(spark, sf):
    return graph.co_occurrence(telemetry(spark, sf).where("event_type = 'file_change'"))


@query("J05_episode_transitions", f"WITH {TELEMETRY_SQL}, {EPISODES_SQL}, ep AS (SELECT session_id, episode, any_value(t) AS t FROM eps GROUP BY 1, 2), l AS (SELECT *, lead(t) OVER (PARTITION BY session_id ORDER BY episode) AS nt FROM ep) SELECT (SELECT count(*) FROM ep) AS contains, (SELECT count(*) FROM l WHERE nt IS NOT NULL) AS related_to, (SELECT count(*) FROM l WHERE (t = 'implementation' AND nt = 'debugging') OR (t = 'debugging' AND nt = 'implementation')) AS caused_by")
def j05(spark, sf):
    e = events.materialise_episodes(events.episodes_of(telemetry(spark, sf), gap_seconds=86400, cap=2))
    _, links = graph.episode_graph(e)
    return links.agg(*[F.count_if(F.col("relation") == r).alias(r) for r in ("contains", "related_to", "caused_by")])


@query("J13_jaccard_pairs", "WITH t AS (SELECT doc_id, source, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{3,}')) AS w FROM documents), x AS (SELECT doc_id, source, list_filter(w, lambda y: NOT list_contains(['also','and','about','after','agent','agents','around','before','build','change','changes','code','details','debug','debugging','during','error','errors','file','files','fix','fixed','from','into','issue','issues','memory','need','needs','now','output','project','request','review','reviewed','reviewing','session','summary','that','the','then','this','test','tests','update','updated','using','with','work'], y)) AS w FROM t), p AS (SELECT a.source, a.doc_id AS l, b.doc_id AS r, len(list_intersect(a.w, b.w)) AS k, len(a.w) AS na, len(b.w) AS nb FROM x a JOIN x b ON a.source = b.source AND a.doc_id < b.doc_id AND least(len(a.w), len(b.w)) >= 0.5 * greatest(len(a.w), len(b.w))) SELECT source, l AS \"left\", r AS \"right\", k::INT AS shared, round(k / (na + nb - k), 6)::DOUBLE AS similarity FROM p WHERE k >= 4 AND k / (na + nb - k) >= 0.5")
def j13(spark, sf):
    d = read(spark, sf, "documents").withColumn("tokens", text.similarity_tokens(F.col("text")))
    return graph.similar_pairs(d, "doc_id", "tokens", ["source"]).select("source", "left", "right", "shared", six(F.col("similarity")).alias("similarity"))


@query("J23_headings_links", r"SELECT page_id, len(regexp_extract_all(html, '<h[1-6][^>]*>'))::INT AS headings, len(regexp_extract_all(html, 'href=.([^ >]*)', 1))::INT AS links FROM pages")
def j23(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("(<h[1-6][^>]*>)"), F.lit(1))).alias("headings"), F.size(F.regexp_extract_all("html", F.lit("href=.([^ >]*)"), F.lit(1))).alias("links"))


@query("J25_short_hash", "SELECT doc_id, left(sha256(text), 12) AS h FROM documents")
def j25(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.stable_id(F.col("text"), 12).alias("h"))


@query("K01_two_hop", f"WITH RECURSIVE {GRAPH_SQL}, b AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges), h1 AS (SELECT DISTINCT b AS id FROM b WHERE a = 'nation:3'), h2 AS (SELECT DISTINCT b.b AS id FROM b JOIN h1 ON b.a = h1.id) SELECT id, min(hop)::INT AS hop FROM (SELECT 'nation:3' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY 1")
def k01(spark, sf):
    _, e = order_graph(spark, sf)
    return traverse.neighbours(e, spark.createDataFrame([("nation:3",)], "id string"), 2)


@query("K02_shortest_path", f"WITH RECURSIVE {GRAPH_SQL}, b AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges), p AS (SELECT 'region:0' AS id, 0 AS hop UNION SELECT b.b, p.hop + 1 FROM p JOIN b ON b.a = p.id WHERE p.hop < 7) SELECT min(hop)::INT AS length FROM p WHERE id = (SELECT min(id) FROM nodes WHERE node_type = 'order')")
def k02(spark, sf):
    n, e = order_graph(spark, sf)
    goal = n.where("node_type = 'order'").agg(F.min("id")).first()[0]
    return traverse.shortest_path(e, "region:0", goal).agg(F.max("pos").alias("length"))


@query("K03_hubs", f"WITH {GRAPH_SQL} SELECT id, degree FROM degree ORDER BY degree DESC, id LIMIT 10")
def k03(spark, sf):
    return graph.hubs(*order_graph(spark, sf)).select("id", "degree")


@query("K05_goal_directed")
def k05(spark, sf):
    n, e = order_graph(spark, sf)
    return traverse.goal_search(n, e, "nation_3 region america places", "nation:3", 3).select(F.array_join("path", ">").alias("path"), "length", "covered", "uncovered", "complete")


@query("K06_sub_goals", "SELECT item_id, array_to_string(list_distinct([]::VARCHAR[]) || (SELECT list(t ORDER BY p) FROM (SELECT t, min(p) AS p FROM (SELECT unnest(w) AS t, generate_subscripts(w, 1) AS p FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9_./:+-]+') AS w)) WHERE length(t) >= 3 AND t NOT IN ('the','and','for','with','from','that','this','what','which','who','how','why','was','were','has','have','had','are','can','all','any','but','not','our','your','his','her','its','ours') GROUP BY t)), ' ') AS goals FROM benchmark")
def k06(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", F.array_join(text.sub_goals(F.col("text")), " ").alias("goals"))


@query("K08_components")
def k08(spark, sf):
    e = telemetry(spark, sf).where("file_path is not null").select(F.concat(F.lit("s"), "session_id").alias("a"), F.col("file_path").alias("b"))
    return components.components(e.distinct())


@query("K09_hub_damping", f"WITH {GRAPH_SQL}, t AS (SELECT degree AS d FROM (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i FROM degree) WHERE i = (SELECT floor(count(*) * 0.95)::BIGINT FROM degree)), f AS (SELECT id, CASE WHEN t.d >= 5 AND degree > t.d THEN 1 / greatest(1, ln(greatest(2, degree))) ELSE 1 END AS f FROM degree, t), b AS (SELECT source AS a, target AS b, weight AS w FROM edges UNION ALL SELECT target, source, weight FROM edges) SELECT b.a, b.b, round(b.w * least(x.f, y.f), 6)::DOUBLE AS w FROM b JOIN f x ON x.id = b.a JOIN f y ON y.id = b.b")
def k09(spark, sf):
    return graph.damped(*order_graph(spark, sf)).select("a", "b", six(F.col("w")).alias("w"))


@query("K10_greedy_clusters")
def k10(spark, sf):
    return cluster.communities(*order_graph(spark, sf)).select("id", F.col("community").cast("long").alias("community"))


@query("K13_leiden_clusters")
def k13(spark, sf):
    return cluster.communities(*order_graph(spark, sf), method="leiden").select("id", F.col("community").cast("long").alias("community"))


@query("D25_modularity", f"WITH {GRAPH_SQL}, m AS (SELECT id, node_type AS c FROM nodes), b AS (SELECT source AS a, target AS b, weight AS w FROM edges UNION ALL SELECT target, source, weight FROM edges), t AS (SELECT x.c, sum(w) AS tot, sum(CASE WHEN x.c = y.c THEN w ELSE 0 END) AS inn FROM b JOIN m x ON x.id = b.a JOIN m y ON y.id = b.b GROUP BY 1) SELECT round(sum(inn / s - (tot / s) ** 2), 6)::DOUBLE AS modularity FROM t, (SELECT sum(tot) AS s FROM t)")
def d25(spark, sf):
    n, e = order_graph(spark, sf)
    return cluster.modularity(e, n.select("id", F.col("node_type").alias("community")))


@query("D11_community_figures", f"WITH {GRAPH_SQL}, m AS (SELECT id, node_type AS c FROM nodes), i AS (SELECT x.c, count(*) AS intra FROM edges e JOIN m x ON x.id = e.source JOIN m y ON y.id = e.target WHERE x.c = y.c GROUP BY 1), z AS (SELECT c, count(*) AS n FROM m GROUP BY 1) SELECT z.c AS community, n AS node_count, coalesce(intra, 0) AS intra_edges, upper(z.c[1]) || z.c[2:] || ' cluster (' || n || ' nodes)' AS label FROM z LEFT JOIN i USING (c)")
def d11(spark, sf):
    n, e = order_graph(spark, sf)
    return graph.community_figures(n.select("id", F.col("node_type").alias("community")), n, e).select("community", "node_count", "intra_edges", "label")


SEARCHES = ("fr/4", "blog", "note", "see www html", "function", "About m")


def _score_sql(q: str) -> str:
    """The points of each rule, by hand, over lower-cased columns."""
    q = q.lower()
    path_like, name_like = any(c in q for c in "/\\."), all(c.isascii() and (c.isalnum() or c in "_:-.") for c in q)
    has = lambda column, x: f"coalesce(contains({column}, '{x}'), false)"
    tiers = lambda points, *columns: "CASE " + " ".join(
        f"WHEN {' OR '.join(f'coalesce({test.format(c)}, false)' for c in columns)} THEN {n}" for test, n in zip((f"{{}} = '{q}'", f"starts_with({{}}, '{q}')", f"contains({{}}, '{q}')"), points, strict=True)
    ) + " ELSE 0 END"
    parts = [
        f"CASE WHEN kind IN ('file', 'document') THEN CASE WHEN lid = 'file:{q}' OR lsource = '{q}' OR coalesce(lpath = '{q}', false) OR coalesce(lfile = '{q}', false) THEN 260 ELSE 0 END"
        f" + CASE WHEN base = '{q}' THEN 220 ELSE 0 END + CASE WHEN ends_with(lpath, '{q}') THEN 170 ELSE 0 END + CASE WHEN starts_with(base, '{q}') THEN 140 ELSE 0 END"
        f" + CASE WHEN contains(lpath, '{q}') THEN 110 ELSE 0 END + CASE WHEN ext = '{q.lstrip('.')}' THEN 40 ELSE 0 END + {24 if path_like else 0} ELSE {-48 if path_like else 0} END",
        f"CASE WHEN kind = 'symbol' THEN {tiers((240, 180, 110), 'llabel')} + CASE WHEN symbol_kind = '{q}' THEN 36 ELSE 0 END + {18 if name_like else 0} ELSE 0 END",
        f"CASE WHEN kind = 'module' THEN {tiers((210, 145, 90), 'llabel', 'limport')} ELSE 0 END",
        f"CASE WHEN kind IN ('section', 'rationale', 'document') THEN {tiers((190, 135, 92), 'lheading', 'llabel')} ELSE 0 END",
        f"CASE WHEN tag = '{q}' THEN 170 ELSE 0 END + CASE WHEN {has('lbody', q)} THEN 80 ELSE 0 END",
        f"CASE WHEN hay = '{q}' THEN 12 WHEN contains(hay, '{q}') THEN 4 ELSE 0 END",
        "CASE WHEN contains(coalesce(lpath, lfile, ''), 'build/') THEN -24 ELSE 0 END",
    ]
    for t in q.split():
        parts.append(
            f"CASE WHEN coalesce(base = '{t}', false) OR llabel = '{t}' THEN 18 ELSE 0 END + CASE WHEN {has('lpath', t)} THEN 11 ELSE 0 END"
            f" + CASE WHEN {has('lheading', t)} OR {has('lbody', t)} THEN 9 ELSE 0 END + CASE WHEN contains(hay, '{t}') THEN {2 if len(t) > 3 else 1} ELSE 0 END"
        )
    return "(" + " + ".join(parts) + ")::DOUBLE"


SEARCH_SQL = f"""{PAGE_NODES_SQL},
low AS (SELECT *, lower(id) AS lid, lower(label) AS llabel, lower(source_id) AS lsource, lower(full_path) AS lpath, lower(source_file) AS lfile, lower(import_source) AS limport, lower(body) AS lbody,
  lower(coalesce(heading, CASE WHEN kind IN ('section', 'rationale') THEN label END)) AS lheading, lower(id || ' ' || label || ' ' || meta) AS hay,
  nullif(regexp_extract(lower(full_path), '([^/]*)/*$', 1), '') AS base, nullif(regexp_extract(regexp_extract(lower(full_path), '([^/]*)/*$', 1), '^.+\\.([^.]*)$', 1), '') AS ext FROM pn)"""


@query("E34_node_score", f"WITH {SEARCH_SQL} " + " UNION ALL ".join(f"SELECT page_id, '{q}' AS query, {_score_sql(q)} AS score FROM low" for q in SEARCHES))
def e34(spark, sf):
    n = page_nodes(spark, sf)
    return functools.reduce(DataFrame.union, [n.select("page_id", F.lit(q).alias("query"), traverse.node_score(n, q).alias("score")) for q in SEARCHES])


@query("E35_node_search", f"""WITH {SEARCH_SQL}, s AS (""" + " UNION ALL ".join(f"SELECT '{q}' AS query, id, label, kind, source_file, source_id, {_score_sql(q)} AS score FROM low" for q in SEARCHES) + """),
  d AS (SELECT * FROM s WHERE score > 0 QUALIFY CASE WHEN kind IN ('file', 'document') THEN 1 ELSE row_number() OVER (PARTITION BY query, kind IN ('file', 'document'), coalesce(source_file, source_id) ORDER BY score DESC, label, id) END <= 2)
  SELECT query, id, score FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, label, id) <= 10""")
def e35(spark, sf):
    n = page_nodes(spark, sf)
    return functools.reduce(DataFrame.union, [traverse.search_nodes(n, q).select(F.lit(q).alias("query"), "id", "score") for q in SEARCHES])


# --- L: context ----------------------------------------------------------------------


def _items(spark, sf):
    m = memories(spark, sf)
    return m.select(
        (F.col("id") % 20).alias("request_id"), F.col("id").alias("item_id"), F.when(F.col("id") % 7 == 0, "repository").when(F.col("id") % 11 == 0, "session_graph").when(F.col("id") % 13 == 0, "conflict").otherwise("memory").alias("source_class"),
        "memory_type", "claim_key", "verification", "authority", text.estimate_tokens(F.col("summary")).alias("tokens"), "valid_to", "superseded_by", (F.col("id") % 3).alias("proofs"),
    )


@query("L02_context_priority", f"WITH {MEMORIES_SQL} SELECT id AS item_id, (CASE WHEN id % 7 = 0 THEN 60 WHEN id % 11 = 0 THEN 30 WHEN id % 13 = 0 THEN 45 ELSE 50 END + CASE verification WHEN 'verified' THEN 25 WHEN 'inferred' THEN 8 ELSE -4 END + CASE authority WHEN 'repository' THEN 20 WHEN 'test_verified' THEN 18 WHEN 'tool_verified' THEN 16 WHEN 'user_confirmed' THEN 14 WHEN 'session_derived' THEN 4 ELSE -10 END + CASE WHEN memory_type IN ('decision', 'fact', 'constraint', 'fix') THEN 14 WHEN memory_type IN ('task', 'bug') THEN 10 WHEN memory_type = 'implementation_detail' THEN 8 WHEN memory_type = 'open_question' THEN 6 ELSE -6 END)::INT AS priority FROM mem")
def l02(spark, sf):
    return _items(spark, sf).select("item_id", context.priority("hybrid").alias("priority"))


ITEMS_SQL = f"""{MEMORIES_SQL},
items AS (SELECT id % 20 AS request_id, id AS item_id, CASE WHEN id % 7 = 0 THEN 'repository' WHEN id % 11 = 0 THEN 'session_graph' WHEN id % 13 = 0 THEN 'conflict' ELSE 'memory' END AS source_class,
  memory_type, claim_key, verification, authority, greatest(1, octet_length(encode(summary)) // 4)::BIGINT AS tokens, superseded_by, id % 3 AS proofs FROM mem)"""
ADMISSIBLE_SQL = "(source_class <> 'memory' OR (authority <> 'model_derived' AND verification NOT IN ('contradicted', 'unverified') AND superseded_by IS NULL))"


@query("B20_admissible", f"WITH {ITEMS_SQL} SELECT item_id FROM items WHERE {ADMISSIBLE_SQL}")
def b20(spark, sf):
    return _items(spark, sf).where(context.admissible()).select("item_id")


@query("L01_context_pack", f"""WITH RECURSIVE {ITEMS_SQL},
  scored AS (SELECT *, (CASE source_class WHEN 'repository' THEN 60 WHEN 'session_graph' THEN 30 WHEN 'conflict' THEN 45 ELSE 50 END + CASE verification WHEN 'verified' THEN 25 WHEN 'inferred' THEN 8 ELSE -4 END
    + CASE authority WHEN 'repository' THEN 20 WHEN 'test_verified' THEN 18 WHEN 'tool_verified' THEN 16 WHEN 'user_confirmed' THEN 14 WHEN 'session_derived' THEN 4 ELSE -10 END
    + CASE WHEN memory_type IN ('decision', 'fact', 'constraint', 'fix') THEN 14 WHEN memory_type IN ('task', 'bug') THEN 10 WHEN memory_type = 'implementation_detail' THEN 8 WHEN memory_type = 'open_question' THEN 6 ELSE -6 END)::INT AS priority,
    CASE WHEN source_class = 'memory' THEN 'memory:' || memory_type ELSE source_class END AS bucket FROM items),
  once AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY request_id, claim_key ORDER BY priority DESC, tokens DESC, item_id) = 1),
  listed AS (SELECT *, CASE WHEN bucket = 'repository' THEN 4 ELSE 2 END AS quota, row_number() OVER (PARTITION BY request_id ORDER BY priority DESC, tokens DESC, item_id) AS n FROM once),
  fold AS (SELECT DISTINCT request_id, 0::BIGINT AS n, 0::BIGINT AS used, false AS took, []::VARCHAR[] AS held FROM listed
    UNION ALL SELECT request_id, n, CASE WHEN ok THEN used + tokens ELSE used END, ok, CASE WHEN ok THEN held || [bucket] ELSE held END
      FROM (SELECT f.request_id, l.n, f.used, f.held, l.tokens, l.bucket, f.used + l.tokens <= 600 AND len(list_filter(f.held, lambda x: x = l.bucket)) < l.quota AS ok FROM fold f JOIN listed l ON l.request_id = f.request_id AND l.n = f.n + 1))
  SELECT l.request_id, item_id, CASE WHEN source_class <> 'memory' THEN source_class ELSE CASE memory_type WHEN 'decision' THEN 'decisions' WHEN 'task' THEN 'active_tasks' WHEN 'constraint' THEN 'constraints' WHEN 'fact' THEN 'facts' WHEN 'bug' THEN 'bugs'
      WHEN 'fix' THEN 'fixes' WHEN 'open_question' THEN 'open_questions' WHEN 'implementation_detail' THEN 'implementation_details' WHEN 'risk' THEN 'risks' WHEN 'change_log' THEN 'change_log' ELSE 'summaries' END END AS section,
    tokens, priority, max(f.used) OVER (PARTITION BY l.request_id) AS used_tokens FROM listed l JOIN fold f ON f.request_id = l.request_id AND f.n = l.n WHERE took""")
def l01(spark, sf):
    return context.pack(_items(spark, sf), 600)


def _cover_sql(budget: int, goals: tuple[str, ...]) -> str:
    """Each item covers one goal, so the greedy cover takes each goal's best item, best first, until one does not fit."""
    return f"""{ITEMS_SQL},
  able AS (SELECT *, CASE WHEN source_class = 'memory' THEN CASE memory_type WHEN 'decision' THEN 'decisions' WHEN 'task' THEN 'active_tasks' WHEN 'fact' THEN 'facts' WHEN 'bug' THEN 'bugs' WHEN 'fix' THEN 'fixes' WHEN 'constraint' THEN 'constraints'
      WHEN 'implementation_detail' THEN 'implementation' WHEN 'open_question' THEN 'open_questions' END END AS goal,
    CASE authority WHEN 'repository' THEN 1.0 WHEN 'user_confirmed' THEN 1.0 WHEN 'tool_verified' THEN 0.95 WHEN 'test_verified' THEN 0.95 WHEN 'session_derived' THEN 0.55 ELSE 0.0 END::DOUBLE AS factor FROM items WHERE {ADMISSIBLE_SQL}),
  rated AS (SELECT *, factor * greatest(0.25, least(1.0, proofs / 2.0)) / tokens AS rate,
    CASE source_class WHEN 'repository' THEN 0.8 WHEN 'memory' THEN 0.6 WHEN 'session_graph' THEN 0.5 ELSE 0.7 END::DOUBLE * factor AS filler FROM able),
  first AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY request_id, claim_key ORDER BY item_id) = 1),
  best AS (SELECT * FROM first WHERE goal IN {goals} QUALIFY row_number() OVER (PARTITION BY request_id, goal ORDER BY rate DESC, item_id) = 1),
  cover AS (SELECT *, (row_number() OVER w - 1)::INT AS place, sum(tokens) OVER w AS used FROM best WINDOW w AS (PARTITION BY request_id ORDER BY rate DESC, item_id) QUALIFY sum(tokens) OVER w <= {budget}),
  spent AS (SELECT request_id, max(used)::BIGINT AS used, count(*) AS places FROM cover GROUP BY 1),
  listed AS (SELECT r.*, row_number() OVER (PARTITION BY r.request_id ORDER BY filler DESC, item_id) AS n FROM rated r ANTI JOIN cover c ON c.request_id = r.request_id AND c.claim_key = r.claim_key),
  fold AS (SELECT DISTINCT l.request_id, 0::BIGINT AS n, coalesce(s.used, 0)::BIGINT AS used, false AS took FROM listed l LEFT JOIN spent s USING (request_id)
    UNION ALL SELECT f.request_id, l.n, CASE WHEN f.used + l.tokens <= {budget} THEN f.used + l.tokens ELSE f.used END, f.used + l.tokens <= {budget} FROM fold f JOIN listed l ON l.request_id = f.request_id AND l.n = f.n + 1),
  chosen AS (SELECT request_id, item_id, 'proof' AS stage, place, goal AS covers FROM cover
    UNION ALL SELECT l.request_id, l.item_id, 'filler', (coalesce(s.places, 0) + row_number() OVER (PARTITION BY l.request_id ORDER BY l.n) - 1)::INT, NULL
      FROM listed l JOIN fold f ON f.request_id = l.request_id AND f.n = l.n LEFT JOIN spent s ON s.request_id = l.request_id WHERE took)"""


@query("L06_set_cover", f"WITH RECURSIVE {_cover_sql(500, ('decisions', 'active_tasks', 'facts', 'bugs', 'fixes'))} SELECT * FROM chosen")
def l06(spark, sf):
    goals = context.goals_of(F.concat(F.lit("fix the bug in request "), F.col("request_id").cast("string")))
    return context.compile_cover(_items(spark, sf).withColumn("goals", goals), 500)


@query("L10_proof_gaps", f"""WITH RECURSIVE {_cover_sql(300, ('decisions', 'active_tasks', 'facts', 'bugs', 'fixes', 'open_questions'))}
  SELECT r.request_id, array_to_string(list_sort(list_filter(['decisions', 'active_tasks', 'facts', 'bugs', 'fixes', 'open_questions'], lambda g: NOT list_contains(coalesce(c.got, []), g))), ',') AS gaps
  FROM (SELECT DISTINCT request_id FROM items) r LEFT JOIN (SELECT request_id, list(covers) AS got FROM chosen WHERE covers IS NOT NULL GROUP BY 1) c USING (request_id)""")
def l10(spark, sf):
    goals = context.goals_of(F.lit("fix the open bug"))
    items = _items(spark, sf).withColumn("goals", goals)
    return context.proof_gaps(items.select("request_id", "goals").distinct(), context.compile_cover(items, 300)).select("request_id", F.array_join("gaps", ",").alias("gaps"))


@query("L07_sub_goals", "SELECT item_id, array_to_string(['decisions', 'active_tasks', 'facts'] || CASE WHEN regexp_matches(lower(text), 'bug|error|debug|fail') THEN ['bugs', 'fixes'] ELSE [] END || CASE WHEN regexp_matches(lower(text), 'constraint|must |requirement|invariant') THEN ['constraints'] ELSE [] END || CASE WHEN regexp_matches(lower(text), 'implement|refactor|build |code|module') THEN ['implementation'] ELSE [] END || CASE WHEN regexp_matches(lower(text), 'question|unknown|unclear|open ') THEN ['open_questions'] ELSE [] END, ',') AS goals FROM benchmark")
def l07(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", F.array_join(context.goals_of(F.col("text")), ",").alias("goals"))


# --- M: scalars ------------------------------------------------------------------------


@query("M05_canonical", f"SELECT doc_id, {CANON('text')} AS canonical FROM documents")
def m05(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.canonical(F.col("text")).alias("canonical"))


@query("M06_fnv1a", "SELECT page_id, list_reduce(list_transform(string_split(url, ''), lambda c: ascii(c)::BIGINT), lambda h, x: (xor(h, x) * 16777619) & 4294967295, 2166136261::BIGINT) AS h FROM pages")
def m06(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.fnv1a(F.col("url")).alias("h"))


@query("M08_line_numbers", "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS line FROM documents")
def m08(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.line_number(F.col("text"), F.length("text")).cast("long").alias("line"))


@query("Q18_estimate_tokens", "SELECT doc_id, greatest(1, octet_length(encode(text)) // 4)::INT AS tokens FROM documents")
def q18(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to episodes to claims to the best twelve for a continuation."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    segmented = events.episodes_of(telemetry(spark, sf_dir))
    drafts = claims.atomic_claims(segmented).where("persisted")
    hits = drafts.select(
        F.concat_ws(":", "event_id", "pos").alias("id"), F.col("claim_type").alias("memory_type"), "title", F.col("segment").alias("summary"), "created_at", "importance", "confidence", "authority", "verification",
        F.array("session_id").alias("session_ids"), F.lit(1.0).alias("lexical_score"), F.lit(None).cast("double").alias("semantic_score"),
    )
    from loomspan.plans.search import with_defaults

    return ranking.disclose(ranking.diversify(ranking.fuse(with_defaults(hits), ranking.Request("continue with open work", now=datetime(2024, 6, 1), continuation=True))), 12).select("id", "memory_type", "title", "rank", "level", six(F.col("final_score")).alias("final_score"))
