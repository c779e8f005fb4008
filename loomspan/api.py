"""A façade of the engine's tools over a store."""

from __future__ import annotations

import html
import re
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.text import estimate_tokens
from loomspan.operators import claims, cluster, context, events, graph, ranking, reconcile, relational, traverse
from loomspan.plans import search
from loomspan.plans.lineage import cut
from loomspan.plans.report import knowledge_report, unified_report
from loomspan.schemas import EVENT_TYPES, GOVERNANCE, INTENTS
from loomspan.sources import code, repository
from loomspan.sources.store import Store, node_link


class RequestError(ValueError):
    """A request that breaks a rule."""


def need(ok: bool, message: str) -> None:
    if not ok:
        raise RequestError(message)


@dataclass
class Engine:
    """Sessions, memories, claims and graphs of a store. Times are given, never read from a clock."""

    store: Store
    project: str = "default"

    # --- sessions ---

    def session_start(self, session_id: str, provider: str, at: datetime, branch: str | None = None) -> None:
        need(bool(session_id.strip()), "a session needs an id")
        need(bool(re.fullmatch(r"[a-z0-9._-]{1,64}", provider.strip().lower())), "a provider is 1 to 64 of a-z, 0-9, ., _ and -")
        self._session(session_id, "active", at, provider.strip().lower(), branch)

    def session_end(self, session_id: str, at: datetime) -> None:
        self._session(session_id, "completed", at, None, None)

    def _session(self, session_id: str, status: str, at: datetime, provider: str | None, branch: str | None) -> None:
        row = self.store.spark.createDataFrame([(session_id, self.project, status, provider, branch, at)], "session_id string, project_id string, status string, provider string, branch string, changed_at timestamp")
        self.store.append("sessions", row)

    def sessions(self) -> DataFrame:
        rows = self.store.read("sessions")
        w = relational.latest(rows, ["session_id"], ["changed_at"])
        known = rows.groupBy("session_id").agg(F.max("provider").alias("_p"), F.max("branch").alias("_b"))
        return w.join(known, "session_id").withColumns({"provider": F.coalesce("provider", "_p"), "branch": F.coalesce("branch", "_b")}).drop("_p", "_b")

    def append_events(self, batch: DataFrame) -> DataFrame:
        """Store the new events of active sessions; returns the batch with ``duplicate`` and ``accepted``."""
        stored = self.store.read("events") if self.store.exists("events") else batch.limit(0)
        active = self.sessions().where("status = 'active'").select("session_id").withColumn("_active", F.lit(True))
        marked = events.append_once(stored, batch, order="ordinal").join(active, "session_id", "left")
        known = F.col("event_type").isin(*EVENT_TYPES)
        out = marked.withColumn("accepted", F.coalesce("_active", F.lit(False)) & known & ~F.col("duplicate")).drop("_active")
        out = cut(out)
        self.store.append("events", out.where("accepted").select(*batch.columns))
        return out

    def derive(self) -> dict[str, DataFrame]:
        return search.session_pipeline(self.store.read("events"))

    # --- memories ---

    def search(self, memories: DataFrame, request: ranking.Request, k: int = 10) -> DataFrame:
        need(request.intent in INTENTS, f"unknown intent {request.intent}")
        need(1 <= k <= 100, "1 to 100 hits")
        return search.hybrid_search(memories, request, k)

    def memory_get(self, memories: DataFrame, ids: list) -> DataFrame:
        need(0 < len(ids) <= 20, "1 to 20 ids")
        return memories.where(F.col("id").isin(*ids))

    def govern(self, table: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
        need(decisions.where(~F.col("state").isin(*GOVERNANCE)).isEmpty(), "unknown governance state")
        return claims.govern(table, decisions)

    def reconcile(self, table: DataFrame) -> DataFrame:
        edges = reconcile.reconcile_edges(reconcile.prior_candidates(table, table))
        return reconcile.apply_edges(table, edges)

    # --- context ---

    def context_build(self, items: DataFrame, budget: int, intent: str = "hybrid") -> tuple[DataFrame, DataFrame]:
        need(budget > 0, "a budget of tokens")
        return context.pack(items, budget, intent), context.advice(items, intent)

    def context_compile(self, items: DataFrame, objective: str, budget: int, intent: str = "hybrid") -> tuple[DataFrame, DataFrame]:
        need(bool(objective.strip()), "an objective")
        with_goals = items.withColumn("goals", context.goals_of(F.lit(objective)))
        chosen = context.compile_cover(with_goals, budget, intent)
        return chosen, context.proof_gaps(with_goals.select("request_id", "goals").distinct(), chosen)

    # --- graphs ---

    def build_graph(self, layer: str, snapshot: str, nodes: DataFrame, edges: DataFrame, at: datetime) -> None:
        need(layer in ("repository", "session"), "a layer is repository or session")
        members = cut(cluster.communities(nodes, edges))
        figures = graph.community_figures(members.select("id", "community"), nodes, edges)
        self.store.save_snapshot(self.project, layer, snapshot, nodes, edges, figures, at, members.select("id", "community"))

    def graph(self, layer: str) -> tuple[DataFrame, DataFrame]:
        found = self.store.load_snapshot(self.project, layer)
        if found is None and layer == "session":
            found = self.store.load_snapshot("global", layer)
        need(found is not None, f"no {layer} graph")
        return found

    def graph_query(self, layer: str, kind: str, **options) -> DataFrame:
        return traverse.query(kind, *self.graph(layer), **options)

    def report(self, layer: str) -> str:
        return knowledge_report(*self.graph(layer))

    def communities(self, layer: str) -> DataFrame:
        """The communities of a layer's head, largest first; no rows where the layer has no graph."""
        found = self.store.load_part(self.project, layer, "communities")
        need(found is not None, f"no {layer} graph")
        return found.orderBy(F.desc("node_count"), F.desc("cohesion_score"), "community")

    def memory_communities(self, at: datetime, layer: str = "session", seconds: int = 300) -> DataFrame | None:
        """memory_id, community by the layer's head; None where it has no graph.

        The map is kept with the snapshot for so many seconds: a request within
        them reads it alone, neither nodes nor edges. A head that has moved, or a
        map that is older, makes a new one from the snapshot's members, or, of a
        snapshot without, from its graph.
        """
        head = self.store.head(self.project, layer)
        if head is None:
            return None
        kept = self.store.kept_map(self.project, layer, head, at, seconds)
        if kept is None:
            members = self.store.load_part(self.project, layer, "members")
            if members is None or members.isEmpty():
                members = cluster.communities(*self.graph(layer)).select("id", "community")
            self.store.keep_map(self.project, layer, head, graph.memory_communities(members), at)
            kept = self.store.kept_map(self.project, layer, head, at, seconds)
        return kept

    def project_resolve(self, name: str | None = None, project_id: str | None = None) -> dict:
        """The project of an id, or else of a name, and whether it was made now. The global project is never found by either.

        A blank or missing name is ``unnamed-project``; a new project takes the
        given id or a random one, and its slug from that. Of projects of one
        name the first made is found.
        """
        name = (name or "").strip() or "unnamed-project"
        if project_id is not None:
            project_id = str(uuid.UUID(project_id))
        if self.store.exists("projects"):
            own = self.store.read("projects").where("slug <> 'global'")
            found = own.where(F.col("id") == project_id if project_id else F.col("name") == name).orderBy("nth", "id").first()
            if found is not None:
                return {"project_id": found["id"], "name": found["name"], "created": False}
        made = project_id or str(uuid.uuid4())
        nth = self.store.read("projects").count() if self.store.exists("projects") else 0
        row = (made, name, f"project-{made.replace('-', '')[:12]}", nth)
        self.store.append("projects", self.store.spark.createDataFrame([row], "id string, name string, slug string, nth long"))
        return {"project_id": made, "name": name, "created": True}

    def unified_report(self) -> str:
        """A report across layers, of those that there are."""
        return unified_report(*[self.store.load_snapshot(self.project, layer) for layer in ("repository", "session")])

    def repository_sync(self, files: list[dict], removed: list[str], at: datetime) -> tuple[DataFrame, DataFrame]:
        """Parse files (path, hash, content), put their parts in the place of what stems from them and from removed ones, and save the graph."""
        need(all(f.get("path") and f.get("hash") for f in files), "files need a path and a hash")
        spark = self.store.spark
        given = spark.createDataFrame([(f["path"], f.get("content")) for f in files], "path string, text string")
        given = given.where(~repository.is_ignored(F.col("path")) & (F.octet_length(F.coalesce("text", F.lit(""))) <= repository.TEXT_CAP)).withColumn("language", repository.language(F.col("path")))
        nodes, edges = code.code_graph(given.select("path"), code.parts_of(given))
        known = self.store.load_snapshot(self.project, "repository")
        if known is not None:
            touched = spark.createDataFrame([(p,) for p in {f["path"] for f in files} | set(removed)], "path string")
            nodes, edges = graph.incremental_sync(known[0].select(*nodes.columns), known[1].select(*edges.columns), nodes, edges, touched)
        nodes, edges = cut(nodes), cut(edges)
        self.build_graph("repository", f"sync-{at.isoformat()}", nodes, edges, at)
        return nodes, edges

    def save_artifacts(self, layer: str, manifest: DataFrame | None = None) -> list[str]:
        """A layer's graph as node-link lines, its report as markdown and as a page, and a manifest (path, hash) of its files; their names.

        Lines and manifest are written by the tasks; the report is small.
        """
        nodes, edges = self.graph(layer)
        report, folder = knowledge_report(nodes, edges), f"artifacts/{self.project}-{layer}"
        tables = {"node_link": node_link(nodes, edges)} | ({"manifest": manifest.select("path", "hash")} if manifest is not None else {})
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(self.store.path(f"{folder}/{name}"))
        page = f"<!doctype html><meta charset='utf-8'><title>{html.escape(self.project)}</title><pre>{html.escape(report)}</pre>"
        for name, body in (("report", report), ("page", page)):
            self.store.save_artifact(f"{self.project}-{layer}/{name}", body)
        return [f"{folder}/{name}" for name in (*tables, "report", "page")]

    def dashboard_graph(self, layer: str, memories: DataFrame, links: DataFrame, most: int = 200) -> tuple[DataFrame, DataFrame]:
        """A layer's graph; where there is none, the newest memories as nodes, with the links (source, target, relation, weight) among them."""
        found = self.store.load_snapshot(self.project, layer)
        if found is not None:
            return found
        newest = memories.orderBy(F.desc("created_at"), "memory_id").limit(most)
        nodes = graph.memory_graph(newest)[0]
        ids = nodes.select("id")
        inside = links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
        return nodes, inside.orderBy(F.desc("weight"), "source", "target").limit(most)

    def context_for(self, memories: DataFrame, objective: str, budget: int, intent: str = "hybrid", now: datetime | None = None, queries: tuple[str, ...] = (), compiled: bool = False, scopes: bool = True) -> DataFrame:
        """From an objective to the sections of its pack: memories that answer it, nodes of the repository's graph, conflicts apart.

        ``compiled`` takes the smallest proof set in place of the pack by priority;
        without ``scopes`` the objective alone is searched for.
        """
        need(bool(objective.strip()) and budget > 0, "an objective and a budget")
        request = ranking.Request(query=objective, intent=intent, now=now or datetime(1970, 1, 1))
        hits = search.context_hits(memories, request, queries, scopes=scopes)
        own, bad = context.conflict_split(hits)
        columns = ["item_id", "source_class", "memory_type", "claim_key", "title", "summary", "verification", "authority", "tokens", "valid_to", "superseded_by", "proofs"]
        none = F.lit(None).cast("string")
        has = lambda name: F.col(name).cast("string") if name in hits.columns else none
        items = own.unionByName(bad).select(
            F.concat(F.lit("memory:"), F.col("id").cast("string")).alias("item_id"), "source_class", "memory_type", has("claim_key").alias("claim_key"), "title", "summary", "verification", "authority",
            estimate_tokens(F.coalesce("summary", F.lit(""))).alias("tokens"), has("valid_to").alias("valid_to"), has("superseded_by").alias("superseded_by"), (F.size("provenance") if "provenance" in hits.columns else F.lit(0)).alias("proofs"),
        )
        known = self.store.load_snapshot(self.project, "repository") if intent in ("repository_only", "hybrid") else None
        if known is not None:
            found = context.repository_items(known[0], objective)
            items = items.unionByName(found.withColumns({c: none for c in columns if c not in (*found.columns, "proofs")} | {"proofs": F.lit(0)}).select(*columns))
        items = cut(items.withColumns({"request_id": F.lit("r"), "goals": context.goals_of(F.lit(objective))}))
        chosen = context.compile_cover(items, budget, intent) if compiled else context.pack(items, budget, intent)
        return context.context_pack(items, chosen, context.verified_truth() if compiled else None)

    def health(self) -> dict:
        """Whether the store's root can be read, and which tables it has."""
        tables = ("sessions", "events", "graph_heads", "vectors", "audit_log")
        return {"ready": True, "project": self.project, "tables": [t for t in tables if self.store.exists(t)]}

    def export(self, layer: str) -> DataFrame:
        return node_link(*self.graph(layer))
