"""Reports of graphs: markdown from bounded aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators import graph


def knowledge_report(nodes: DataFrame, edges: DataFrame, communities: DataFrame | None = None, title: str = "Knowledge graph") -> str:
    """Statistics, evidence shares, the ten best-linked nodes, and the eight largest communities."""
    s = graph.statistics(nodes, edges, 0 if communities is None else communities.count()).first()
    total = max(1, s["edge_count"])
    lines = [f"# {title}", "", f"- Nodes: {s['node_count']}", f"- Edges: {s['edge_count']}", f"- Average degree: {s['avg_degree']:g}", f"- Density: {s['density']:g}", f"- Isolated nodes: {s['isolated_nodes']}", ""]
    lines += ["## Evidence", ""] + [f"- {k}: {s[k]} ({100 * s[k] / total:.0f}%)" for k in ("extracted", "inferred", "ambiguous")]
    kinds = nodes.groupBy("node_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node_type").limit(6).collect()
    lines += ["", "## Node types", ""] + [f"- {r['node_type']}: {r['n']}" for r in kinds]
    lines += ["", "## Hubs", ""] + [f"- {r['label']} ({r['node_type']}, degree {r['degree']})" for r in graph.hubs(nodes, edges).where("degree > 1").collect()]
    if communities is not None:
        top = communities.orderBy(F.desc("node_count"), F.desc("cohesion_score"), "community").limit(8).collect()
        lines += ["", "## Communities", ""] + [f"- {r['label']}: cohesion {r['cohesion_score']:g}" for r in top]
    return "\n".join(lines) + "\n"


def unified_report(repository: tuple[DataFrame, DataFrame] | None, session: tuple[DataFrame, DataFrame] | None) -> str:
    """What stands out across layers, of those that there are: most modified files, decisions, tasks and bugs, and hubs of the code."""
    lines: list[str] = []

    def section(title: str, rows: list[str]) -> None:
        if rows:
            lines.extend([f"### {title}", *rows, ""])

    if session is not None:
        nodes, edges = session
        section("Most Modified Files", [f"- `{r['path']}` ({r['n']} sessions)" for r in modified_files(edges).limit(10).collect()])
        for kind, title in (("decision", "Active Decisions"), ("task", "Open Tasks"), ("bug", "Known Bugs")):
            own = nodes.where(F.col("node_type") == kind)
            n = own.count()
            section(f"{title} ({n})", [f"- {r['label']}" for r in own.orderBy("id").limit(5).collect()] if n else [])
    if repository is not None:
        nodes, edges = repository
        code = nodes.where(~F.col("node_type").isin("session", "module"))
        top = code.join(graph.degrees(nodes, edges).select("id", "degree"), "id").orderBy(F.desc("degree"), "id").limit(10)
        section("Architectural Hubs", [f"- `{r['label']}` (degree {r['degree']})" for r in top.collect()])
    return "\n".join(lines) if lines else "No cross-layer data available."


def modified_files(edges: DataFrame) -> DataFrame:
    """path, n: modifies and touched_by edges of each file, most first."""
    rel = edges.where(F.col("relation").isin("modifies", "touched_by"))
    end = F.when(F.col("target").startswith("file:"), F.col("target")).when(F.col("source").startswith("file:"), F.col("source"))
    return rel.select(F.substring(end, 6, 1 << 20).alias("path")).where("path is not null").groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path")
