"""Sharding: a minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.plans.lineage import cut, read


@dataclass
class Segment:
    """The groups whose digests start with ``prefix``; atomic if it is one group."""

    prefix: str
    size: int
    atomic: bool


def _forward(segments: list[Segment], shards: int, capacity: int, fluid: bool) -> list[int]:
    """The farthest places at which greedily filled shards end; fluid: within a segment of many groups, anywhere."""
    cuts, start, k, before = [], 0, 0, 0
    for _ in range(shards):
        reach = start + capacity
        while k < len(segments) and before + segments[k].size <= reach:
            before += segments[k].size
            k += 1
        start = max(start, reach if fluid and k < len(segments) and not segments[k].atomic else before)
        cuts.append(start)
    return cuts


def _least(segments: list[Segment], shards: int, fluid: bool) -> int:
    """Binary search for the smallest capacity at which the greedy check passes."""
    total = sum(s.size for s in segments)
    low, high = -(-total // shards), total
    while low < high:
        mid = (low + high) // 2
        if _forward(segments, shards, mid, fluid)[-1] >= total:
            high = mid
        else:
            low = mid + 1
    return low


def _touched(segments: list[Segment], ranges: list[tuple[int, int]]) -> list[int]:
    """Segments of many groups that overlap a range of places."""
    out, at = [], 0
    for k, s in enumerate(segments):
        if not s.atomic and s.size and any(low < at + s.size and high > at for low, high in ranges):
            out.append(k)
        at += s.size
    return out


def plan_cuts(segments: list[Segment], shards: int, refine) -> tuple[list[str], int]:
    """Prefixes at which shards 1, 2, ... begin, and the minimax capacity.

    ``refine(prefixes)`` gives the finer segments of each prefix. Only segments
    that a cut may fall into are refined: bounds come from the same greedy
    check with segments taken as atoms (too few cuts) and as fluid (too many).
    Among the cuts that keep every shard within the capacity, each is the one
    nearest to an equal share.
    """
    total = sum(s.size for s in segments)
    while True:
        low, high = _least(segments, shards, True), _least(segments, shards, False)
        mirrored = segments[::-1]
        ranges = []
        ahead = zip(_forward(segments, shards, low, False), _forward(segments, shards, high, True), strict=True)
        behind = zip(_forward(mirrored, shards, low, False), _forward(mirrored, shards, high, True), strict=True)
        ranges += [(a, b + 1) for a, b in ahead if a < total] + [(total - b - 1, total - a) for a, b in behind if a < total]
        ranges += [(total * j // shards - 1, total * j // shards + 1) for j in range(1, shards)]
        wide = _touched(segments, ranges)
        if not wide:
            break
        finer = refine([segments[k].prefix for k in wide])
        fresh: list[Segment] = []
        for k, s in enumerate(segments):
            fresh += finer[s.prefix] if s.prefix in finer else [s]
        segments = fresh
    farthest = _forward(segments, shards, low, False)
    nearest = [total - x for x in _forward(segments[::-1], shards, low, False)][-2::-1]
    places, at = [(0, "")], 0
    for s in segments:
        places.append((at, s.prefix))
        at += s.size
    cuts, last = [], 0
    for j in range(1, shards):
        reach = min(farthest[j - 1], last + low)
        ideal = total * j / shards
        open_ = [p for p in places if nearest[j - 1] <= p[0] <= reach] if total else []
        place = min(open_, key=lambda p: abs(p[0] - ideal), default=None)
        if place is None or reach >= total and abs(total - ideal) < abs(place[0] - ideal):
            cuts.append("g")  # above every hexadecimal digest
            last = total
        else:
            cuts.append(place[1])
            last = place[0]
    return cuts, low


def shard_by_bytes(docs: DataFrame, shards: int = 16, first: int = 3, step: int = 2, slot_buckets: int = 1024) -> DataFrame:
    """Deal all documents into shards of nearly equal bytes, equal texts together.

    Returns ``doc_id, size, text_crc32, digest, shard, slot``. Groups of equal
    texts are ordered by SHA-256. Groups larger than an equal share (fewer than
    ``shards``) come first and fill a shard each; the rest are cut contiguously
    so that the largest shard is as small as can be. The driver sees sums by
    digest prefix only: 16**first at the start, then 16**step for each prefix
    that a cut may fall into. A document's shard follows from its digest by
    comparison with the cuts, so no join and no shuffle of groups is needed; a
    slot is a row number within one of ``slot_buckets`` hashed buckets of a
    shard plus the bucket's offset, so that a shard of one text is still
    numbered in parallel.

    Null text is empty (size 1, a group with empty texts). Rows with a null or
    repeated doc_id are kept, each with its own slot. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("digest")))
    groups = cut(rows.groupBy("digest").agg(F.sum("size").alias("size")))
    total = groups.agg(F.sum("size")).first()[0] or 0
    # At most ``shards`` rows: those that may exceed an equal share.
    large = groups.orderBy(F.desc("size"), "digest").limit(shards).collect()
    alone: list[str] = []
    rest, left = total, shards
    for g in large:
        if left <= 1 or g["size"] * left <= rest:
            break
        alone.append(g["digest"])
        rest, left = rest - g["size"], left - 1
    small = groups.where(~F.col("digest").isin(alone)) if alone else groups

    def sums(width: int, within: list[str] | None = None) -> list:
        found = small if within is None else small.where(F.substring("digest", 1, len(within[0])).isin(within))
        return sorted(found.groupBy(F.substring("digest", 1, width).alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect())

    def refine(prefixes: list[str]) -> dict[str, list[Segment]]:
        out: dict[str, list[Segment]] = {p: [] for p in prefixes}
        for width in sorted({len(p) for p in prefixes}):
            for r in sums(width + step, [p for p in prefixes if len(p) == width]):
                out[r["prefix"][:width]].append(Segment(r["prefix"], r["size"], r["n"] == 1))
        return out

    cuts, _ = plan_cuts([Segment(r["prefix"], r["size"], r["n"] == 1) for r in sums(first)], left, refine)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("digest") >= c).cast("int")
    shard = shard + F.lit(len(alone))
    for k, digest in enumerate(alone):
        shard = F.when(F.col("digest") == digest, k).otherwise(shard)
    dealt = rows.withColumn("shard", shard.cast("int")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(slot_buckets)).cast("int"))
    # At most shards * slot_buckets rows.
    filled = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    offsets = filled.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "digest"))
    return (
        dealt.withColumn("nth", nth)
        .join(F.broadcast(offsets), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "digest", "shard", (F.col("offset") + F.col("nth") - 1).alias("slot"))
    )


def op10_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(read(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
