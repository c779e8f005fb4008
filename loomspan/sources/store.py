"""Tables as Parquet folders: appends, snapshots with heads, vector collections, artifacts, audit log."""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.relational import upsert
from loomspan.operators.retrieval import fan_out, nearest_typed


@dataclass(frozen=True)
class Store:
    """A root folder, local or in any file system that Spark reads."""

    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(table))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def append(self, table: str, rows: DataFrame, by: list[str] | None = None) -> None:
        w = rows.write.mode("append")
        (w.partitionBy(*by) if by else w).parquet(self.path(table))

    # --- graph snapshots ---

    def save_snapshot(self, project: str, layer: str, snapshot: str, nodes: DataFrame, edges: DataFrame, communities: DataFrame, created_at, members: DataFrame | None = None) -> None:
        """An immutable snapshot of a layer, with its nodes' communities if given, and its head: the head is the row of the latest time."""
        tag = lambda df: df.withColumns({"project_id": F.lit(project), "layer": F.lit(layer), "snapshot_id": F.lit(snapshot)})
        for name, df in (("nodes", nodes), ("edges", edges), ("communities", communities), *([("members", members)] if members is not None else [])):
            self.append(f"graph_{name}", tag(df), ["project_id", "layer", "snapshot_id"])
        head = self.spark.createDataFrame([(project, layer, snapshot, created_at)], "project_id string, layer string, snapshot_id string, created_at timestamp")
        self.append("graph_heads", head)

    def heads(self) -> DataFrame:
        return self.read("graph_heads").groupBy("project_id", "layer").agg(F.max_by("snapshot_id", F.struct("created_at", "snapshot_id")).alias("snapshot_id"))

    def load_snapshot(self, project: str, layer: str) -> tuple[DataFrame, DataFrame] | None:
        """The head's nodes and edges."""
        nodes = self.load_part(project, layer, "nodes")
        return None if nodes is None else (nodes, self.load_part(project, layer, "edges"))

    def head(self, project: str, layer: str) -> str | None:
        """The snapshot that a layer's head names."""
        found = self.heads().where((F.col("project_id") == project) & (F.col("layer") == layer)).first() if self.exists("graph_heads") else None
        return None if found is None else found["snapshot_id"]

    def load_part(self, project: str, layer: str, part: str) -> DataFrame | None:
        """The head's nodes, edges, communities or members: partition filters, so other snapshots are not read."""
        head = self.head(project, layer)
        if head is None or not self.exists(f"graph_{part}"):
            return None
        at = (F.col("project_id") == project) & (F.col("layer") == layer) & (F.col("snapshot_id") == head)
        return self.read(f"graph_{part}").where(at).drop("project_id", "layer", "snapshot_id")

    # --- communities of memories, kept for a time ---

    def keep_map(self, project: str, layer: str, snapshot: str, rows: DataFrame, at) -> None:
        """A snapshot's map (memory_id, community) as of a time; it is seen once its row in ``community_map_heads`` is."""
        name = f"{int(at.timestamp() * 1e6)}"
        tag = {"project_id": F.lit(project), "layer": F.lit(layer), "snapshot_id": F.lit(snapshot), "made": F.lit(name)}
        self.append("community_maps", rows.withColumns(tag), ["project_id", "layer", "snapshot_id", "made"])
        self.append("community_map_heads", self.spark.createDataFrame([(project, layer, snapshot, name, at)], "project_id string, layer string, snapshot_id string, made string, made_at timestamp"))

    def kept_map(self, project: str, layer: str, snapshot: str, at, seconds: int) -> DataFrame | None:
        """The last map of a snapshot that is not older than so many seconds, by partition filters."""
        if not self.exists("community_map_heads"):
            return None
        same = (F.col("project_id") == project) & (F.col("layer") == layer) & (F.col("snapshot_id") == snapshot)
        fresh = (F.col("made_at") <= F.lit(at)) & (F.col("made_at") >= F.lit(at) - F.make_dt_interval(secs=F.lit(seconds)))
        found = self.read("community_map_heads").where(same & fresh).agg(F.max_by("made", "made_at")).first()[0]
        return None if found is None else self.read("community_maps").where(same & (F.col("made").cast("string") == found)).select("memory_id", "community")

    # --- vectors ---

    def upsert_vectors(self, items: DataFrame, version: int, scope: str = "") -> None:
        """Items (id, memory_type, embedding, deleted) of a version; readers take the latest of each collection and id."""
        self.append("vectors", fan_out(items, scope).withColumn("version", F.lit(version)), ["collection"])

    def vectors(self) -> DataFrame:
        """The live items: of each collection and id the latest version, unless that deletes it. Reads the last compacted base and what came after."""
        rows = self.read("vectors")
        if self.exists("vector_bases"):
            last = self.read("vector_bases").agg(F.max("upto")).first()[0]
            rows = self.read(f"vector_base_{last}").unionByName(rows.where(F.col("version") > last))
        live = upsert(rows.limit(0), rows, ["collection", "id"], ["version"])
        return live.where("not coalesce(deleted, false)")

    def compact_vectors(self, upto: int) -> None:
        """Write the live items of versions up to ``upto`` as a base, which readers take from then on in place of those versions.

        The base is complete before it is named, and earlier ones stay, so readers are never without one.
        """
        rows = self.read("vectors").where(F.col("version") <= upto)
        live = upsert(rows.limit(0), rows, ["collection", "id"], ["version"]).where("not coalesce(deleted, false)")
        live.write.mode("overwrite").partitionBy("collection").parquet(self.path(f"vector_base_{upto}"))
        self.append("vector_bases", self.spark.createDataFrame([(upto,)], "upto int"))

    def search_vectors(self, query: list[float], k: int, types: list[str] | None = None, scope: str = "") -> DataFrame:
        """The k nearest of the asked collections; vectors of another size than the query's are an error."""
        names = types or ["all"]
        asked = [f"{scope}_{n}" for n in names] if scope else names
        live = self.vectors().where(F.col("collection").isin(*asked))
        other = live.where(F.size("embedding") != len(query)).first()
        if other is not None:
            raise ValueError(f"vector {other['id']} has {len(other['embedding'])} dimensions, the query has {len(query)}")
        return nearest_typed(live, query, k, asked)

    def get_vector(self, id_: str, collection: str = "all") -> DataFrame:
        return self.vectors().where((F.col("collection") == collection) & (F.col("id") == id_))

    # --- small artifacts ---

    def save_artifact(self, name: str, body: str) -> None:
        self.spark.createDataFrame([(name, body)], "name string, body string").coalesce(1).write.mode("overwrite").parquet(self.path(f"artifacts/{name}"))

    def audit(self, actor: str, action: str, target: str, at) -> None:
        self.append("audit_log", self.spark.createDataFrame([(actor, action, target, at)], "actor string, action string, target string, created_at timestamp"))


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, json: a line for each node and link of a node-link export, spread over tasks."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("json"))
    return n.unionByName(edges.select(F.lit("link").alias("kind"), F.to_json(F.struct(*edges.columns)).alias("json")))


def node_link_document(nodes: DataFrame, edges: DataFrame, most: int = 20_000) -> str:
    """One JSON document of a graph of at most ``most`` lines; a larger one is refused, ``node_link`` takes it."""
    rows = node_link(nodes, edges).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} nodes and links: export node_link() instead")
    part = lambda k: [json.loads(r["json"]) for r in rows if r["kind"] == k]
    return json.dumps({"directed": True, "multigraph": True, "nodes": part("node"), "links": part("link")}, sort_keys=True)


def id_map_faults(forward: DataFrame, backward: DataFrame, records: DataFrame) -> DataFrame:
    """fault, id: what is wrong with the id maps of a vector index; no rows if they are one to one and records have their own keys.

    forward: uuid, number; backward: number, uuid; records: key, id.
    """
    uuid = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    there = forward.join(backward.select("number", F.col("uuid").alias("back")), "number", "left")
    back = backward.join(forward.select("uuid", F.col("number").alias("there")), "uuid", "left")
    faults = (
        forward.where(~F.col("uuid").rlike(uuid)).select(F.lit("not a uuid").alias("fault"), F.col("uuid").alias("id")),
        there.where("back is null").select(F.lit("no reverse mapping"), F.col("uuid")), there.where("back <> uuid").select(F.lit("maps to another uuid"), F.col("uuid")),
        back.where("there is null").select(F.lit("no forward mapping"), F.col("uuid")), back.where("there <> number").select(F.lit("maps to another number"), F.col("uuid")),
        records.where("key <> id").select(F.lit("record key"), F.col("key")),
    )
    return functools.reduce(DataFrame.unionAll, faults)


def normalised_maps(forward: DataFrame, backward: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Both id maps, made of an old one (number, uuid) where the new ones are empty, and the next free number.

    Of several numbers of a uuid in the old map the least counts.
    """
    if backward.isEmpty():
        backward = old.select("number", "uuid").dropDuplicates(["number"])
        forward = backward.groupBy("uuid").agg(F.min("number").alias("number")).unionByName(forward)
    most = backward.agg(F.max("number")).first()[0] or 0
    return forward, backward, max(1, most + 1)
