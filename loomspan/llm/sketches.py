"""MinHash near-dedup with SetSketch registers: banded values, joint likelihood, exact verification, components."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.filters import bit_of, flags, is_set
from loomspan.llm.kernel import BLANK, LOWER, Splitter, chunks, mapped, mix, signed, split, texts, windows
from loomspan.operators.components import components
from loomspan.plans.lineage import cut, read

#: Registers hold floor(1 - log_BASE(x)) of the least of exponentials with rate RATE, cut off to 0 .. LIMIT.
BASE, RATE, LIMIT = 1.001, 20.0, 65535
ROWS, BANDS = 3, 22
REGISTERS = ROWS * BANDS
#: A candidate whose most likely similarity is this far below the threshold is not verified: over five standard errors.
SLACK = 0.25
#: Buckets with more members, or more bytes of sets, than this are not compared in one task; larger ones are ranked in parts.
BLOCK, BLOCK_BYTES = 8192, 1 << 24
_WORDS = Splitter(BLANK, LOWER, seed=6)
_RNG = np.random.default_rng(66)
_A = _RNG.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32)


def registers_of(minima: np.ndarray) -> np.ndarray:
    """Registers of the least 32-bit hashes: exponentially spaced and truncated. Monotone, so the least hash is enough."""
    u = (minima.astype(np.float64) + 0.5) / 2**32
    x = -np.log1p(-u) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, LIMIT).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


def likeliest(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 100) -> np.ndarray:
    """Similarity at which the counts of larger, smaller and equal registers are likeliest, given both set sizes.

    a, b: registers by row. The probability that a register of one set is the
    larger is p(u - v * J), with u and v the sets' shares of the summed sizes
    and p(x) = -log_BASE(1 - x * (BASE - 1) / BASE).
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u
    best, out = np.full(len(a), -np.inf), np.zeros(len(a))
    most = np.minimum(u, v) / np.maximum(u, v)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    for k in range(steps + 1):
        j = most * k / steps
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        value = more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, tiny))
        better = value > best
        best[better], out[better] = value[better], j[better]
    return out


def shingle_hashes(w, size: int) -> list[np.ndarray]:
    """Distinct shingles of each text, sorted: all runs of ``size`` words, or the whole sequence if it is shorter."""
    out = []
    whole = windows(w.hashes, size)
    for i in range(len(w.first) - 1):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            out.append(mix(windows(w.hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("row_hash"))


def sketch_documents(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, row_hash, n_shingles, digest (128 bits of the sorted set), registers (16-bit values as bytes); map-side only."""

    def run(batches):
        tables = _WORDS.tables()
        for batch in batches:
            data, offsets = texts(batch.column(1))
            sizes, digests, sketches = [], [], []
            for i, j in chunks(offsets):
                w = split(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], _WORDS, tables)
                sets = shingle_hashes(w, shingle)
                counts = np.array([len(s) for s in sets])
                full = np.flatnonzero(counts)
                least = np.zeros((len(sets), REGISTERS), np.uint16)
                if len(full):
                    x = (np.concatenate([sets[k] for k in full]) >> np.uint64(32)).astype(np.uint32)
                    at = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
                    minima = np.stack([np.minimum.reduceat(x * a + b, at) for a, b in zip(_A, _B, strict=True)], 1)
                    least[full] = registers_of(minima)
                sizes += counts.tolist()
                digests += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                sketches += [r.tobytes() for r in least]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())],
                ["doc_id", "row_hash", "n_shingles", "digest", "registers"],
            )

    return mapped(_identified(docs), run, "doc_id long, row_hash long, n_shingles long, digest binary, registers binary")


def _bands(classes: DataFrame) -> DataFrame:
    """rep, n_shingles, bucket: one row for each band of ROWS registers."""

    def run(batches):
        mult = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)[:ROWS]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            r = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(n, BANDS, ROWS).astype(np.uint64)
            keys = mix(mix((r * mult).sum(2)) + np.arange(BANDS, dtype=np.uint64)).reshape(-1)
            take = pa.array(np.repeat(np.arange(n), BANDS))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), signed(keys)], ["rep", "n_shingles", "bucket"])

    return mapped(classes.select("rep", "n_shingles", "registers"), run, "rep long, n_shingles long, bucket long")


def _likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose joint estimate is at least ``least``."""
    left = classes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
    right = classes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, REGISTERS) for k in (4, 5))
            na, nb = (batch.column(k).to_numpy().astype(float) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(likeliest(ra, rb, na, nb) >= least))

    return mapped(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ra", "rb"), run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """rep, shingles (sorted 64-bit values as bytes) of the wanted classes (column rep).

    A filter of fixed size picks their documents where they are read, so no
    other text is shingled and no text is shuffled.
    """
    rows = cut(classes.join(wanted.distinct(), "rep", "left_semi").select("rep", "doc", "row_hash"))
    bits, size = flags(rows, "doc", "row_hash")
    known = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        tables = _WORDS.tables()
        for batch in batches:
            batch = batch.filter(pa.array(is_set(known.value, batch.column(3).to_numpy())))
            data, offsets = texts(batch.column(1))
            for i, j in chunks(offsets):
                w = split(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], _WORDS, tables)
                found = pa.array([s.tobytes() for s in shingle_hashes(w, shingle)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), found], ["doc", "row_hash", "shingles"])

    own = _identified(docs).where("doc_id is not null").withColumn("bit", bit_of(size, "doc_id", "row_hash"))
    full = mapped(own.select("doc_id", "text", "row_hash", "bit"), run, "doc long, row_hash long, shingles binary")
    # A row that is there several times is one set; joins on rep follow, so this deals no further.
    return full.join(rows, ["doc", "row_hash"]).select("rep", "shingles").dropDuplicates(["rep"])


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full shingle sets."""
    full = _sets(docs, pairs.select(F.col("a").alias("rep")).union(pairs.select("b")), classes, shingle)

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = full.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = full.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    return mapped(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb"), check, "a long, b long")


def near_duplicate_groups(docs: DataFrame, shingle: int = 3, percent: int = 85) -> DataFrame:
    """Group documents that are linked by shingle sets of ``percent`` similarity at least.

    Returns ``doc_id, row_hash, n_shingles, component_id, kept``, a row for each
    row of ``docs``; row_hash tells texts of one doc_id apart. Sets are of distinct runs of ``shingle`` lower-cased words.

    1. Documents with equal sets form a class, named by its least doc_id; from
       here on only classes count, so thousands of copies are one row.
    2. Each class has REGISTERS SetSketch registers. Classes that agree on all
       ROWS registers of one of BANDS bands share a bucket. At 85 % a link shares
       none with a chance of 1e-9, at 80 % of 1e-7.
    3. In each bucket, a member is paired with the least member, and with the
       one before it in size order: as many pairs as members. Pairs whose sizes or joint
       likelihood estimate exclude a link go, the rest is verified on full sets.
    4. Verified links join members to components. A bucket whose members are
       then in one component is done, and of buckets with the same members one
       is. In the others every pair across components that can be a link is
       compared on full sets, in large buckets by a prefix filter; only links
       that join two components are passed on, and no such link is left out.
    5. Components of all links give component_id.

    Null text is empty, and an empty document is linked with nothing. A row
    with a null doc_id is linked with nothing and gives a null component and
    kept false. Rows that repeat a doc_id are classed and linked each by its own
    text, so one doc_id may be in several components. No rows give no rows; other
    columns are ignored.
    """
    sketched = cut(sketch_documents(docs, shingle))
    usable = sketched.where("doc_id is not null and n_shingles > 0")
    exact = usable.groupBy("digest", "n_shingles").agg(F.min(F.struct("doc_id", "row_hash")).alias("least"), F.first("registers").alias("registers"))
    exact = exact.select("digest", "n_shingles", F.col("least.doc_id").alias("doc"), F.col("least.row_hash").alias("row_hash"), "registers")
    # A class is named by its document; of a document with several texts the further classes by a hash of their sets.
    nth = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n_shingles"), "digest"))
    exact = cut(exact.withColumn("rep", F.when(nth == 1, F.col("doc")).otherwise(F.bitwise_not(F.shiftrightunsigned(F.xxhash64("digest"), 2)))))
    classes = exact.drop("digest")
    least = percent / 100 - SLACK
    banded = _bands(classes)
    h = F.xxhash64("rep")
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("members"), F.min("rep").alias("pivot"), F.sum("n_shingles").alias("volume"), F.sum(h % (1 << 40)).alias("_sum"), F.bit_xor(h).alias("_xor")).where("members > 1")
    # Bands often gather the same members: one bucket of each such set is enough.
    buckets = buckets.groupBy("members", "pivot", "volume", "_sum", "_xor").agg(F.min("bucket").alias("bucket")).select("bucket", "members", "pivot", "volume")
    members = cut(banded.join(buckets, "bucket"))
    part = F.when(F.col("members") > BLOCK, F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / (BLOCK // 2)))).otherwise(0)
    near = members.withColumn("part", part).withColumn("prior", F.lag("rep").over(Window.partitionBy("bucket", "part").orderBy("n_shingles", "rep")))
    stars = near.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
    chains = near.where("prior is not null").select(F.least("rep", "prior").alias("a"), F.greatest("rep", "prior").alias("b"))
    pairs = stars.union(chains).where("a < b").distinct()
    first = cut(_verified(cut(_likely(pairs, classes, least)), classes, docs, shingle, percent))
    label = cut(components(first))
    # Buckets that still hold several components; two or three members were all paired above.
    open_ = members.where("members > 2").join(label, members.rep == label.node, "left").select("bucket", "rep", "members", "volume", F.coalesce("component", "rep").alias("component"))
    mixed = open_.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    rest = cut(open_.join(mixed, "bucket"))
    second = cut(_across(rest, _sets(docs, rest.select("rep"), classes, shingle), percent))
    # Later links join whole components, so they are few: their ends are components' names.
    name = lambda side: label.select(F.col("node").alias(side), F.col("component").alias(f"{side}_to"))
    ends = second.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
    joined = components(ends.distinct())
    onto = joined.select(F.col("node").alias("component"), F.col("component").alias("onto"))
    known = label.select(F.col("node").alias("rep"), "component")
    lone = joined.join(known.select(F.col("rep").alias("node")), "node", "left_anti").select(F.col("node").alias("rep"), "component")
    final = known.join(onto, "component", "left").select("rep", F.coalesce("onto", "component").alias("component")).unionByName(lone)
    # Components are named by their least document.
    joint = final.join(exact.select("rep", "doc"), "rep")
    joint = joint.join(joint.groupBy("component").agg(F.min("doc").alias("least")), "component").select("rep", "least")
    of_class = exact.select("digest", "n_shingles", "rep", "doc").join(joint, "rep", "left").select("digest", "n_shingles", F.coalesce("least", "doc").alias("component"))
    named = sketched.join(of_class, ["digest", "n_shingles"], "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    named = named.withColumn("component_id", F.when(linked, F.col("component")).otherwise(F.col("doc_id")))
    return named.select("doc_id", "row_hash", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _across(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join different components within each bucket, found on full sets (rep, shingles).

    A bucket of up to BLOCK members and BLOCK_BYTES of sets is compared in one
    task, where links are folded as they are found: each one joins two parts of
    its members. Larger ones go by ``_across_large``.
    """
    large = (F.col("members") > BLOCK) | (F.col("volume") * 8 > BLOCK_BYTES)

    def links(key: tuple, rows: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["shingles"]]
        n = np.array([len(x) for x in sets])
        at = np.concatenate([[0], np.cumsum(n)])
        known, flat = np.unique(np.concatenate(sets), return_inverse=True)
        rep = rows["rep"].to_numpy()
        part = np.unique(rows["component"].to_numpy(), return_inverse=True)[1]
        mark = np.zeros(len(known), bool)
        out = []
        for i in range(len(n)):
            near = np.arange(i + 1, len(n))
            near = near[(part[near] != part[i]) & (100 * np.minimum(n[near], n[i]) >= percent * np.maximum(n[near], n[i]))]
            if not len(near):
                continue
            mark[flat[at[i] : at[i + 1]]] = True
            ends = np.cumsum(n[near])
            places = np.arange(ends[-1]) + np.repeat(at[near] - (ends - n[near]), n[near])
            both = np.add.reduceat(mark[flat[places]].astype(np.int64), ends - n[near])
            mark[flat[at[i] : at[i + 1]]] = False
            for j in near[100 * both >= percent * (n[near] + n[i] - both)]:
                if part[j] != part[i]:
                    out.append((int(min(rep[i], rep[j])), int(max(rep[i], rep[j]))))
                    part[part == part[j]] = part[i]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    members = rest.select("bucket", "rep", "component", large.alias("large"))
    one = members.where("not large").drop("large").join(sets, "rep").select("bucket", "rep", "component", "shingles").groupBy("bucket").applyInArrow(links, "a long, b long")
    beyond = members.where("large").drop("large")
    # Without large buckets there is nothing to plan for them.
    return one.distinct() if beyond.isEmpty() else one.unionByName(_across_large(beyond, sets, percent)).distinct()


def _across_large(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The same for buckets beyond one task: a prefix filter in place of all pairs.

    A link across components lies on shingles that two components of the bucket
    hold. A set of n shingles must share ceil(percent * n / 100) of them, so if
    its shared ones are put in order of their frequency, two linked sets have a
    common one among the first of each that leave one less than that behind.
    What only one component holds, and sets with too few shared shingles, drop
    out; a text that many members have in common comes last, so pairs don't
    grow with the bucket's square. Pairs are verified on full sets, and one
    link of each pair of components is passed on.
    """

    def exploded(batches):
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(3)]
            n = np.array([len(x) for x in sets], np.int64)
            take = pa.array(np.repeat(np.arange(len(sets)), n))
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in range(3)], pa.array(np.repeat(n, n)), pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], ["bucket", "rep", "component", "n", "t"])

    each = mapped(rest.join(sets, "rep").select("bucket", "rep", "component", "shingles"), exploded, "bucket long, rep long, component long, n long, t long")
    often = each.groupBy("bucket", "t").agg(F.count("*").alias("df"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket", "t", "df")
    own = Window.partitionBy("bucket", "rep")
    shared = each.join(often, ["bucket", "t"]).withColumns({"nth": F.row_number().over(own.orderBy("df", "t")), "held": F.count("*").over(own)})
    first = cut(shared.where(F.col("nth") <= F.col("held") - F.ceil(F.col("n") * percent / 100) + 1).select("bucket", "t", "rep", "component", "n"))
    side = lambda s: first.select("bucket", "t", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "component", "n")])
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    pairs = side("a").join(side("b"), ["bucket", "t"]).where((F.col("component_a") < F.col("component_b")) & sizes)
    pairs = pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), "component_a", "component_b").distinct()

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    full = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    found = mapped(full.select("a", "b", "component_a", "component_b", "sa", "sb"), check, "a long, b long, component_a long, component_b long")
    link = found.groupBy("component_a", "component_b").agg(F.min(F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).alias("link"))
    return link.select("link.a", "link.b")


def op6_setsketch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(read(spark, sf_dir, "documents"), 3, 85).drop("row_hash")


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS rep, list(doc_id) AS docs FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
items AS (SELECT rep, len(s) AS n, md5_number_lower(x) AS h FROM (SELECT rep, s, unnest(s) AS x FROM classes)),
shared AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k
  FROM items a JOIN items b ON a.h = b.h AND a.rep < b.rep AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY ALL),
links AS (
  SELECT a, b FROM shared WHERE 100 * k >= 85 * (na + nb - k)
  UNION SELECT b, a FROM shared WHERE 100 * k >= 85 * (na + nb - k)
  UNION SELECT rep, d FROM (SELECT rep, unnest(docs) AS d FROM classes) WHERE d <> rep
  UNION SELECT d, rep FROM (SELECT rep, unnest(docs) AS d FROM classes) WHERE d <> rep),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM sets UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM sets s JOIN (SELECT node, min(seen) AS c FROM reach GROUP BY node) m ON m.node = s.doc_id
"""
