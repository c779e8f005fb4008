"""Phrase collocation mining: hash buckets count the next longer n-grams in each pass, and prune them with Apriori before the exact count."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.filters import flags, is_set
from loomspan.llm.kernel import LOWER, Splitter, chunks, mapped, signed, split, texts, windows
from loomspan.plans.lineage import cut, read

#: Bytes that end a piece, besides which space and tab part words.
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_PARTS = _ENDS.copy()
_PARTS[[0x20, 0x09]] = True
_WORDS = Splitter(_PARTS, LOWER, seed=11)
#: Buckets of a pass, as a power of two: a bitmap of 32 MB at most, beyond which it prunes less.
LEAST_BUCKETS, MOST_BUCKETS = 16, 28
#: Buckets of a row of counts, as a power of two.
_SEGMENT = 13
_CHUNK = 1 << 20
_SALTS = 32
_PASSED = "lang string, phrase string, key long, n long, segment int, counts binary"


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
    """The ``size`` words from each place on, joined by one space."""
    word = (at[:, None] + np.arange(size)).ravel()
    length = ends[word] - starts[word] + 1
    last = np.arange(size - 1, len(word), size)
    length[last] -= 1
    offsets = np.concatenate([[0], np.cumsum(length)])
    # Each word takes its bytes and one more, which becomes the space.
    source = np.arange(offsets[-1]) + np.repeat(starts[word] - offsets[:-1], length)
    out = data[np.minimum(source, len(data) - 1)]
    out[np.delete(offsets[1:], last) - 1] = 0x20
    bounds = offsets[np.concatenate([[0], last + 1])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out))])


def _lang_salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class _Counts:
    """Counts by key, with the lang and text of one occurrence each; merged as they grow."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []

    def add(self, keys: np.ndarray, lang: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, size: int) -> None:
        if len(at):
            kinds, first, n = np.unique(keys, return_index=True, return_counts=True)
            self.parts.append((kinds, n, lang[first], _joined(data, starts, ends, at[first], size)))

    def batch(self, langs: pa.Array) -> pa.RecordBatch | None:
        if not self.parts:
            return None
        keys, n, lang = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        kinds, first, group = np.unique(keys, return_index=True, return_inverse=True)
        total = np.bincount(group, n).astype(np.int64)
        text = pa.chunked_array([p[3] for p in self.parts]).combine_chunks().take(pa.array(first))
        none = len(kinds)
        columns = [langs.take(pa.array(lang[first])), text.cast(pa.binary()).cast(pa.string()), signed(kinds), pa.array(total), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "key", "n", "segment", "counts"])


def _counter(least: int) -> type:
    return np.uint8 if least < 256 else np.uint32


def _segments(hits: list[np.ndarray], least: int) -> pa.RecordBatch | None:
    """A row of compressed bucket counts, none beyond ``least``, for each segment of buckets that was hit."""
    hit = np.sort(np.concatenate(hits)) if hits else np.zeros(0, np.uint32)
    if not len(hit):
        return None
    new = np.flatnonzero(np.concatenate([[True], hit[1:] != hit[:-1]]))
    bucket, n = hit[new], np.minimum(np.diff(new, append=len(hit)), least)
    segment = bucket >> _SEGMENT
    bounds = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1], [True]]))
    packed, codec = [], pa.Codec("zstd", compression_level=1)
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        dense = np.zeros(1 << _SEGMENT, _counter(least))
        dense[bucket[i:j] & ((1 << _SEGMENT) - 1)] = n[i:j]
        packed.append(codec.compress(dense, asbytes=True))
    m = len(packed)
    columns = [pa.nulls(m, pa.string()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(segment[bounds[:-1]].astype(np.int32)), pa.array(packed, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "key", "n", "segment", "counts"])


def _pass(rows: DataFrame, size: int, least: int, buckets: int, frequent, hot, longer: bool) -> DataFrame:
    """One pass over the texts: exact counts of the ``size``-grams that may be frequent, and bucket counts of the next longer ones.

    A place counts if both its shorter n-grams are frequent (Apriori; a filter of
    exact counts) and its bucket is hot; a longer one goes to a bucket only if
    both n-grams in it count. ``frequent`` and ``hot`` are broadcast bits, None
    in the first pass. Words are told apart by 64-bit keyed hashes within a
    batch of rows, and by themselves from there on.
    """

    def run(batches):
        tables = _WORDS.tables()
        for batch in batches:
            data, offsets = texts(batch.column(1))
            kinds = batch.column(0).dictionary_encode()
            code = kinds.indices.to_numpy()
            salts = np.array([_lang_salt(x) for x in kinds.dictionary.to_pylist()], np.uint64)
            counts, hits = _Counts(), []
            for i, j in chunks(offsets, _CHUNK):
                part = data[offsets[i] : offsets[j]]
                w = split(part, offsets[i : j + 1] - offsets[i], _WORDS, tables)
                if len(w.starts) < size:
                    continue
                doc = np.repeat(np.arange(i, j), np.diff(w.first))
                lang, piece = code[doc], np.cumsum(_ENDS[part], dtype=np.int32)[w.starts]
                next_ = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
                salt = salts[lang]
                key = lambda k: windows(w.hashes, k) ^ salt[: max(len(w.hashes) - k + 1, 0)]  # noqa: B023, E731
                own = key(size)
                ok = np.ones(len(own), bool)
                for k in range(size - 1):
                    ok &= next_[k : k + len(own)]
                if frequent is not None:
                    bits, n = frequent.value
                    shorter = is_set(bits, key(size - 1) & np.uint64((1 << n) - 1))
                    ok &= shorter[:-1] & shorter[1:] & is_set(hot.value, own & np.uint64((1 << buckets) - 1))
                at = np.flatnonzero(ok)
                counts.add(own[at], lang[at], np.frombuffer(part.tobytes().translate(LOWER), np.uint8), w.starts, w.ends, at, size)
                if longer and len(own) > 1:
                    both = np.flatnonzero(ok[:-1] & ok[1:] & next_[size - 1 : size - 1 + len(own) - 1])
                    hits.append((key(size + 1)[both] & np.uint64((1 << buckets) - 1)).astype(np.uint32))
            for found in (counts.batch(kinds.dictionary), _segments(hits, least)):
                if found is not None:
                    yield found

    return mapped(rows, run, _PASSED)


def _hot_buckets(passed: DataFrame, least: int, buckets: int) -> np.ndarray:
    """Packed bits of the buckets with ``least`` hits or more: rows of a segment are added up one after the other, in any number."""

    def run(batches):
        codec, now, total = pa.Codec("zstd"), None, None

        def done():
            bits = np.packbits(total >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits], pa.binary())], ["segment", "bits"])

        for batch in batches:
            for segment, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if segment != now:
                    if now is not None:
                        yield done()
                    now, total = segment, np.zeros(1 << _SEGMENT, np.int64)
                total += np.frombuffer(codec.decompress(counts.as_py(), (1 << _SEGMENT) * np.dtype(_counter(least)).itemsize, asbytes=True), _counter(least))
        if now is not None:
            yield done()

    rows = passed.where("segment is not null").select("segment", "counts").repartition("segment").sortWithinPartitions("segment")
    out = np.zeros(1 << buckets >> 3, np.uint8)
    step = 1 << _SEGMENT >> 3
    # 1 KB a segment, at most 32 MB together.
    for r in mapped(rows, run, "segment int, bits binary").collect():
        out[r["segment"] * step : (r["segment"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return out


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5, buckets: int | None = None) -> DataFrame:
    """lang, phrase, size, n: words and phrases of up to ``longest`` words that occur ``least`` times or more in their lang.

    Exact counts of words come last with n_lang, all occurrences of words in
    that lang. See ``collocations`` for what a word, a piece and a phrase are.
    ``buckets`` is a power of two of hash buckets a pass; by default some 12
    words of text meet in a bucket where ``least`` is 100.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if buckets is None:
        words = (rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // 6
        buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, (8 * words // least).bit_length()))
    buckets = max(buckets, _SEGMENT)
    context = docs.sparkSession.sparkContext
    found, frequent, hot, totals = None, None, None, None
    for size in range(1, longest + 1):
        passed = cut(_pass(rows, size, least, buckets, frequent, hot, size < longest))
        each = passed.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.first("key").alias("key"))
        if size == 1:
            totals = passed.where("phrase is not null").groupBy("lang").agg(F.sum("n").alias("n_lang"))
        kept = cut(each.where(F.col("n") >= least).withColumn("size", F.lit(size)))
        found = kept if found is None else found.unionByName(kept)
        if size == longest or kept.isEmpty():
            break
        frequent = context.broadcast(flags(kept, bit=lambda n: F.pmod(F.col("key"), F.lit(1 << n)), parts=4))
        hot = context.broadcast(_hot_buckets(passed, least, buckets))
    return _by_salt(found, cut(totals), ["lang"], ["lang"]).select("lang", "phrase", "size", "n", "n_lang")


def _by_salt(many: DataFrame, few: DataFrame, on: list[str], few_on: list[str]) -> DataFrame:
    """many inner join few, whose keys are unique, each dealt to so many tasks: a word that begins most phrases, or a lang of most."""
    keys = {c: f"_few_{c}" for c in few_on}
    salted = few.withColumnsRenamed(keys).withColumn("_few_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    own = many.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)).cast("int"))
    same = F.col("_salt") == F.col("_few_salt")
    for a, b in zip(on, few_on, strict=True):
        same &= F.col(a) == F.col(keys[b])
    return own.join(salted, same).drop("_salt", "_few_salt", *keys.values())


def _slice(words: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, percent: int = 100, top: int = 2000, buckets: int | None = None) -> DataFrame:
    """Each lang's first ``top`` phrases by how much more often their parts stand together than by chance.

    Texts are lower-cased in A-Z and cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces,
    these at spaces and tabs into words. A phrase is 2 to ``longest`` words of
    one piece; candidates occur a >= ``least`` times, overlaps included. A cut
    into two parts that occur l and r times gives floor(1000 * a * n / (l * r)),
    n being all words of the lang; the lowest cut counts, the first of equal
    ones. A candidate goes if a longer one holds it and 100 * a(longer) >=
    ``percent`` * a. Returns ``lang, rank, phrase, a, l, r, n, score`` by score,
    a (both descending) and phrase.

    Each pass counts the n-grams of one size and, by hash buckets, those of the
    next (PCY); buckets of fewer than ``least`` hits and n-grams with an
    infrequent part (Apriori) are never counted, and a place whose two n-grams
    were not counted hits no bucket either (DHP). Bucket counts travel as
    compressed rows of 8,192 buckets, none beyond ``least``, which is all a
    bitmap needs; broadcast are the bitmap of hot buckets and a filter of
    frequent n-grams, 32 MB each at most. Both only let pass more, never less.

    Nulls: a text is empty, a lang ``und``; doc_id is not read, so repeated
    rows count each. No words give no rows. Other columns are ignored.
    """
    found = cut(phrase_counts(docs, least, longest, buckets))
    words = F.split("phrase", " ")
    phrases = found.where("size > 1")
    place = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    cuts = phrases.withColumnRenamed("n", "a").withColumn("k", place)
    cuts = cuts.withColumns({"first": _slice(words, F.lit(1), F.col("k")), "rest": _slice(words, F.col("k") + 1, F.col("size") - F.col("k"))})
    parts = lambda name, n: found.select(F.col("lang"), F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = _by_salt(cuts, parts("first", "l"), ["lang", "first"], ["lang", "first"])
    cuts = _by_salt(cuts, parts("rest", "r"), ["lang", "rest"], ["lang", "rest"])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"_over": F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n_lang"), "_under": exact("l") * exact("r")})
    scored = cuts.withColumn("score", F.expr("_over div _under")).groupBy("lang", "phrase", "a", "n_lang").agg(F.min(F.struct("score", "k", "l", "r")).alias("least"))
    # Phrases inside longer ones, with the count of the most frequent of those.
    inner = phrases.withColumn("m", F.explode(F.when(F.col("size") > 2, F.sequence(F.lit(2), F.col("size") - 1)))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    inner = inner.select("lang", _slice(words, F.col("at"), F.col("m")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("within"))
    open_ = scored.join(inner, ["lang", "phrase"], "left").where(F.col("within").isNull() | (100 * F.col("within") < percent * F.col("a")))
    flat = open_.select("lang", "phrase", "a", "least.l", "least.r", F.col("n_lang").alias("n"), "least.score")
    # The planner keeps the first rows of each lang in every partition, so no lang is sorted whole by one task.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    return flat.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS s FROM words),
grams AS (SELECT lang, w, s, unnest(generate_series(1, least(5, len(w) - s + 1))) AS k FROM starts),
f AS (SELECT lang, k, w[s:s + k - 1] AS g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT lang, k, g, f AS a FROM f WHERE k > 1),
cuts AS (SELECT lang, k, g, a, unnest(generate_series(1, k - 1)) AS c FROM candidates),
scored AS (
  SELECT c.lang, c.k, c.g, c.a, c.c, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[:c.c] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.c + 1:] JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
inside AS (
  SELECT DISTINCT s.lang, s.g FROM candidates s JOIN candidates b ON s.lang = b.lang AND b.k > s.k AND 100 * b.a >= 100 * s.a
  WHERE contains(' ' || array_to_string(b.g, ' ') || ' ', ' ' || array_to_string(s.g, ' ') || ' ')),
ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM lowest l ANTI JOIN inside i ON l.lang = i.lang AND l.g = i.g)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM ranked
QUALIFY rank <= 2000
"""
