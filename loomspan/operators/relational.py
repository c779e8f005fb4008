"""Relational shapes: optional predicates, top rows, latest rows, upserts, paging, lookups, counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filtered(df: DataFrame, equal: dict | None = None, among: dict | None = None, at: str | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Rows that meet the predicates that were given; None and empty lists are no predicate, so what is left is pushed down."""
    for name, value in (equal or {}).items():
        if value is not None:
            df = df.where(F.col(name) == value)
    for name, values in (among or {}).items():
        if values:
            df = df.where(F.col(name).isin(*values))
    if at and since is not None:
        df = df.where(F.col(at) >= F.lit(since))
    if at and until is not None:
        df = df.where(F.col(at) <= F.lit(until))
    return df


def ilike_any(columns: list[str], part: str) -> Column:
    """Whether a column holds the part, in any case; % and _ are themselves."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(part.lower())), F.lit(False))
    return out


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def latest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row of the highest version of each key, by map-side aggregation instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_x"))
    return best.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Stored and fresh rows, the latest of each key."""
    return latest(stored.unionByName(fresh), keys, version)


def insert_or_ignore(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and those fresh ones whose keys are not stored yet."""
    return stored.unionByName(fresh.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))


def replace_children(stored: DataFrame, fresh: DataFrame, parent: str, unique: list[str]) -> DataFrame:
    """Children of parents that ``fresh`` names are replaced by its rows, one a unique key."""
    return stored.join(fresh.select(parent).distinct(), parent, "left_anti").select(*fresh.columns).unionByName(fresh.dropDuplicates(unique))


def set_once(df: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Set a column where it is null; the least of several updates."""
    u = updates.groupBy(key).agg(F.min(column).alias("_new"))
    return df.join(u, key, "left").withColumn(column, F.coalesce(column, "_new")).drop("_new")


def merge_maps(a: Column, b: Column) -> Column:
    """Entries of both, b's where a key is in both."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(a), lambda e: ~F.map_contains_key(b, e["key"])), F.map_entries(b)))


def keyset_page(df: DataFrame, at: str, key: str, cursor: tuple | None = None, n: int = 25) -> DataFrame:
    """The n + 1 newest rows before a cursor (time, key); the last, if there is one, is the next page's sign."""
    if cursor is not None:
        df = df.where((F.col(at) < F.lit(cursor[0])) | ((F.col(at) == F.lit(cursor[0])) & (F.col(key) < F.lit(cursor[1]))))
    return df.orderBy(F.desc(at), F.desc(key)).limit(n + 1)


def either_end_counts(edges: DataFrame, a: str, b: str) -> DataFrame:
    """id, n: edges that touch a node, an edge to itself once."""
    ends = edges.select(F.col(a).alias("id")).unionAll(edges.where(F.col(a) != F.col(b)).select(F.col(b)))
    return ends.groupBy("id").agg(F.count("*").alias("n"))


def either_end_max(edges: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """id, weight: the largest weight of a node's edges."""
    ends = edges.select(F.col(a).alias("id"), F.col(weight).alias("weight")).unionByName(edges.select(F.col(b).alias("id"), F.col(weight).alias("weight")))
    return ends.groupBy("id").agg(F.max("weight").alias("weight"))


def linked_max(edges: DataFrame, a: str, b: str, weight: str, ids: DataFrame) -> DataFrame:
    """linked, weight: nodes at the other end of the ids' edges, either way, with the largest weight."""
    out = edges.select(F.col(a).alias("id"), F.col(b).alias("linked"), F.col(weight).alias("weight"))
    back = edges.select(F.col(b).alias("id"), F.col(a).alias("linked"), F.col(weight).alias("weight"))
    return out.unionByName(back).join(ids, "id", "left_semi").groupBy("linked").agg(F.max("weight").alias("weight"))


def other_ends(edges: DataFrame, a: str, b: str, ids: DataFrame) -> DataFrame:
    """id, other, direction of edges at the ids: two equi-joins instead of an OR."""
    out = edges.select(F.col(a).alias("id"), F.col(b).alias("other"), F.lit("out").alias("direction"))
    back = edges.select(F.col(b).alias("id"), F.col(a).alias("other"), F.lit("in").alias("direction"))
    return out.unionByName(back).join(ids, "id", "left_semi")


def two_key_lookup(df: DataFrame, table: DataFrame, first: tuple[str, str], second: tuple[str, str], value: str) -> DataFrame:
    """The value of a row found by the first key, else by the second; the least of several."""
    x = table.groupBy(F.col(first[1]).alias("_k1")).agg(F.min(value).alias("_v1"))
    y = table.groupBy(F.col(second[1]).alias("_k2")).agg(F.min(value).alias("_v2"))
    both = df.join(x, F.col(first[0]) == F.col("_k1"), "left").join(y, F.col(second[0]) == F.col("_k2"), "left")
    return both.withColumn(value, F.coalesce("_v1", "_v2")).drop("_k1", "_v1", "_k2", "_v2")


def counts_per_parent(parents: DataFrame, children: DataFrame, key: str, foreign: str, name: str) -> DataFrame:
    n = children.groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias(name))
    return parents.join(n, key, "left").na.fill(0, [name])


def queue_summary(jobs: DataFrame, status: str, names: dict[str, str]) -> DataFrame:
    return jobs.agg(*[F.count_if(F.col(status) == k).alias(v) for k, v in names.items()], F.count("*").alias("total"))


def token_savings(memories: DataFrame, content: str, summary: str) -> DataFrame:
    saved = F.expr(f"greatest(length({content}) - length({summary}), 0) div 4")
    return memories.agg(F.count("*").alias("memories"), F.sum(saved).alias("saved"))


def nearest_ranks(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles, the largest and the mean, from a histogram of distinct values.

    Values are ranked per value, not per row, with running counts by range
    partition: a sort of the distinct values, spread over tasks, and one
    small row a partition.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")).repartitionByRange(value).withColumn("p", F.spark_partition_id())
    from loomspan.plans.lineage import cut

    counts = cut(counts)
    before = counts.groupBy("p").agg(F.sum("n").alias("m")).withColumn("before", F.sum("m").over(Window.orderBy("p")) - F.col("m"))
    w = Window.partitionBy("p").orderBy(value)
    ranked = counts.join(F.broadcast(before), "p").withColumn("upto", F.col("before") + F.sum("n").over(w))
    total = counts.agg(F.sum("n")).first()[0] or 0
    import math

    picks = [F.min(F.when(F.col("upto") >= max(1, math.ceil(total * s)), F.col(value))).alias(k) for k, s in shares.items()]
    return ranked.agg(*picks, F.max(value).alias("worst"), F.round(F.sum(F.col(value) * F.col("n")) / total, 6).alias("mean") if total else F.lit(None).cast("double").alias("mean"))


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """Rows with their number, from 0, in an order: ranges are sorted apart, and offset by the rows before, one small row a range."""
    from loomspan.plans.lineage import cut

    ranged = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = ranged.groupBy("_p").agg(F.count("*").alias("_m")).withColumn("_before", F.sum("_m").over(Window.orderBy("_p")) - F.col("_m")).drop("_m")
    # Broadcast: a row a partition.
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.join(F.broadcast(before), "_p").withColumn(name, place).drop("_p", "_before")


def manifest_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, change: added, removed or changed between two manifests."""
    a, b = before.select(key, F.col(value).alias("_a")), after.select(key, F.col(value).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return a.join(b, key, "full").where("not (_a <=> _b)").select(key, change.alias("change"))
