"""Benchmark decontamination: spaced seeds, a join of test and training hashes, verified aligned overlaps."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.kernel import PUNCT, Splitter, chunks, mapped, mix, split, texts, windows
from loomspan.plans.lineage import cut, read

#: Each mask names the token positions that count; those between are ignored.
MASKS = ((0, 1, 4, 5, 6), (0, 1, 2, 4, 7), (0, 2, 4, 5, 7))
SPAN = 1 + max(map(max, MASKS))
#: A contaminated document holds this many aligned words of an item (or all of a shorter one) with at most a fifth substituted.
WINDOW, SUBSTITUTED, SHORTEST = 13, 0.2, 8
#: Items of EXACT to SHORTEST - 1 words must occur as they are.
EXACT = 5
#: Bits of the filter that benchmark seeds set: 2 MB, whatever the benchmark's size.
FILTER_BITS = 24
_WORDS = Splitter(PUNCT, seed=2)
#: Blanks and punctuation beyond ASCII that separate words, and scripts without blanks, whose characters are words each.
_BEYOND = "[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f]"
_ALONE = "([\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff])"


def allowed(words: int) -> int:
    """Words of a window that may be substituted; none of a short item's."""
    return int(words * SUBSTITUTED + 1e-9) if words >= SHORTEST else 0


def masks_cover(words: int, masks: tuple[tuple[int, ...], ...] = MASKS) -> bool:
    """Whether any substitution of ``allowed(words)`` of the words leaves some mask's positions untouched."""
    places = [frozenset(at + i for i in m) for m in masks for at in range(words - max(m))]
    return all(any(not p & set(gone) for p in places) for gone in itertools.combinations(range(words), allowed(words)))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts in lower case with blanks for punctuation beyond ASCII and around characters that are words."""
    if column.null_count:
        column = pc.fill_null(column, "")
    return texts(pc.replace_substring_regex(pc.replace_substring_regex(pc.utf8_lower(column), _BEYOND, " "), _ALONE, r" \1 "))


def seeds(hashes: np.ndarray, mask: int) -> np.ndarray:
    """The hash of each placement of a mask, with the mask's number in it."""
    n = len(hashes) - max(MASKS[mask])
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, mask + 1, np.uint64)
    for k, i in enumerate(MASKS[mask]):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n] * np.uint64(2 * k + 1)
    return mix(out)


def runs(hashes: np.ndarray, words: int) -> np.ndarray:
    """The hash of each run of words, with their number in it."""
    return mix(windows(hashes, words) + np.uint64(words))


def _bits(h: np.ndarray) -> list[np.ndarray]:
    keep = np.uint64((1 << FILTER_BITS) - 1)
    return [(h >> np.uint64(s)) & keep for s in (0, 20, 40)]


def _benchmark(benchmark: DataFrame) -> tuple[DataFrame, list[int], DataFrame]:
    """Items (item_id, row, tokens as bytes), the numbers of words of short ones, and their seeds (seed, item_id, row, at)."""

    def run(batches):
        tables = _WORDS.tables()
        for batch in batches:
            data, offsets = tokens(batch.column(1))
            w = split(data, offsets, _WORDS, tables)
            kept = [k for k in range(batch.num_rows) if w.first[k + 1] - w.first[k] >= EXACT]
            each = [w.hashes[w.first[k] : w.first[k + 1]] for k in kept]
            laid = [[seeds(h, m) for m in range(len(MASKS))] if len(h) >= SHORTEST else [runs(h, len(h))] for h in each]
            found = [[(s, at) for x in own for at, s in enumerate(x.view(np.int64).tolist())] for own in laid]
            kind = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())), batch.column(2).take(pa.array(kept, pa.int64())), pa.array([h.tobytes() for h in each], pa.binary()),
                 pa.array([[{"seed": s, "at": a} for s, a in f] for f in found], kind)],
                ["item_id", "item_row", "words", "seeds"],
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("item_row"))
    items = cut(mapped(source.dropDuplicates(), run, "item_id long, item_row long, words binary, seeds array<struct<seed:long,at:int>>"))
    short = [n for (n,) in items.select((F.octet_length("words") / 8).cast("int").alias("n")).where(F.col("n") < SHORTEST).distinct().collect()]
    return items.select("item_id", "item_row", "words"), short, items.select("item_id", "item_row", F.explode("seeds").alias("s")).select("item_id", "item_row", "s.seed", "s.at")


def _filter(seeds_: DataFrame) -> np.ndarray:
    """Bits that the benchmark's seeds set: at most 2**FILTER_BITS / 64 rows reach the driver."""
    parts = [
        seeds_.select(F.shiftrightunsigned("seed", s).bitwiseAND((1 << FILTER_BITS) - 1).alias("bit"))
        for s in (0, 20, 40)
    ]
    bits = parts[0].union(parts[1]).union(parts[2])
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("set")).collect()
    out = np.zeros(1 << FILTER_BITS >> 6, np.int64)
    for w in words:
        out[w["word"]] = w["set"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document and a benchmark item of which it holds a passage: doc_id, item_id, window_words, matched_words; see contaminated_rows."""
    return contaminated_rows(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("window_words").alias("window_words"), F.max("matched_words").alias("matched_words"))


def contaminated_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document's text and a benchmark item of which it holds a passage.

    Returns ``doc_id, row_hash, item_id, window_words, matched_words``; row_hash
    tells texts of one doc_id apart. The document has a
    run of window_words = min(WINDOW, item's words) words aligned with as many
    of the item's, at most a fifth of them substituted; matched_words is the
    best such run's. Words are lower-case runs of letters and digits, and single
    characters of Chinese and Japanese.

    Every mask of MASKS is laid at every word of documents and items. The three
    masks reach every pattern of allowed substitutions (``masks_cover``). Items
    of EXACT to SHORTEST - 1 words have one seed, all their words, and must occur
    as they are. Document seeds pass a filter of fixed size made from the
    benchmark's, so few rows are shuffled; these meet the benchmark's seeds in an
    equi-join, whose hits name a diagonal (a shift of the item against the
    document). The distinct diagonals of an item and the words around a
    document's hits are verified together.

    Items of fewer than EXACT words are no passage and are not tested; a null text is empty;
    rows with a null id give nothing; rows that repeat an id are tested each.
    Other columns are ignored. No rows on a side: no result.
    """
    items, short, item_seeds = _benchmark(benchmark)
    flags = docs.sparkSession.sparkContext.broadcast(np.packbits(_filter(item_seeds)))
    names = ["doc_id", "row_hash", "region", "words", "hits"]

    def scan(batches):
        tables = _WORDS.tables()
        known = np.unpackbits(flags.value).view(bool)
        kind = pa.list_(pa.struct([("seed", pa.int64()), ("pos", pa.int32())]))
        for batch in batches:
            data, offsets = tokens(batch.column(1))
            rows: list[tuple] = []
            for i, j in chunks(offsets):
                w = split(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], _WORDS, tables)
                found, values = [], []
                for h in [seeds(w.hashes, m) for m in range(len(MASKS))] + [runs(w.hashes, n) for n in short if n <= len(w.hashes)]:
                    a, b, c = _bits(h)
                    hit = np.flatnonzero(known[a])
                    hit = hit[known[b[hit]] & known[c[hit]]]
                    found.append(hit)
                    values.append(h[hit])
                at, value = np.concatenate(found), np.concatenate(values)
                doc = np.searchsorted(w.first, at, "right") - 1
                inside = at + 4 < w.first[doc + 1]  # later positions of a mask are settled by the verification
                at, value, doc = at[inside], value[inside], doc[inside]
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, value, doc = at[order], value[order], doc[order]
                # Hits near each other in one document share a region.
                breaks = np.flatnonzero((np.diff(doc) > 0) | (np.diff(at) > 2 * WINDOW)) + 1
                for part in np.split(np.arange(len(at)), breaks):
                    d = int(doc[part[0]])
                    low = max(int(w.first[d]), int(at[part[0]]) - WINDOW)
                    high = min(int(w.first[d + 1]), int(at[part[-1]]) + WINDOW + SPAN)
                    hits = [{"seed": s, "pos": p} for s, p in zip(value[part].view(np.int64).tolist(), (at[part] - low).tolist(), strict=True)]
                    rows.append((i + d, low - int(w.first[d]), w.hashes[low:high].tobytes(), hits))
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(2).take(take), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], kind)], names
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("row_hash"))
    regions = mapped(source, scan, "doc_id long, row_hash long, region int, words binary, hits array<struct<seed:long,pos:int>>")
    # A region is known by its document, text and place, so repeated rows fold into one.
    regions = cut(regions)
    key = ["doc_id", "row_hash", "region"]
    hits = regions.select(*key, F.explode("hits").alias("h")).select(*key, "h.seed", "h.pos")
    diagonals = hits.join(item_seeds, "seed").groupBy(*key, "item_id", "item_row").agg(F.collect_set(F.col("pos") - F.col("at")).alias("shifts"))
    aligned = (
        diagonals.join(regions.select(*key, "words").dropDuplicates(key), key)
        .join(items.withColumnRenamed("words", "item_words"), ["item_id", "item_row"])
        .select("doc_id", "row_hash", "item_id", "shifts", "words", "item_words")
    )

    def best_run(x: np.ndarray, y: np.ndarray, shift: int, n: int) -> int:
        low, high = max(0, -shift), min(len(y), len(x) - shift)
        if high - low < n:
            return 0
        sums = np.concatenate([[0], np.cumsum(x[low + shift : high + shift] == y[low:high])])
        return int((sums[n:] - sums[:-n]).max())

    def verify(batches):
        for batch in batches:
            sizes, best = [], []
            for shifts, a, b in zip(batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                sizes.append(min(WINDOW, len(y)))
                best.append(max(best_run(x, y, shift, sizes[-1]) for shift in shifts))
            keep = [m >= n - allowed(n) for n, m in zip(sizes, best, strict=True)]
            columns = [*batch.columns[:3], pa.array(sizes, pa.int32()), pa.array(best, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_hash", "item_id", "window_words", "matched_words"]).filter(pa.array(keep, pa.bool_()))

    passed = mapped(aligned, verify, "doc_id long, row_hash long, item_id long, window_words int, matched_words int")
    return passed.groupBy("doc_id", "row_hash", "item_id").agg(F.max("window_words").alias("window_words"), F.max("matched_words").alias("matched_words"))


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[\x{00A0}-\x{00BF}\x{2000}-\x{206F}\x{3000}-\x{303F}]', ' ', 'g'), '([\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}])', ' \1 ', 'g'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[\x{00A0}-\x{00BF}\x{2000}-\x{206F}\x{3000}-\x{303F}]', ' ', 'g'), '([\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}])', ' \1 ', 'g'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
bw AS (SELECT item_id, least(len(w), 13) AS n, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM b WHERE len(w) >= 5),
-- With at most a fifth of 8 to 13 words substituted, three in a row are not; of 5 to 7 words none may be.
dg AS (SELECT doc_id, p, t || ' ' || lead(t) OVER x || ' ' || lead(t, 2) OVER x AS g FROM dw WINDOW x AS (PARTITION BY doc_id ORDER BY p)),
bg AS (SELECT item_id, n, p, t || ' ' || lead(t) OVER x || ' ' || lead(t, 2) OVER x AS g FROM bw WINDOW x AS (PARTITION BY item_id ORDER BY p)),
diagonals AS (SELECT DISTINCT doc_id, item_id, dg.p - bg.p AS shift FROM dg JOIN bg USING (g)),
aligned AS (
  SELECT g.doc_id, g.item_id, g.shift, bw.n, bw.p, (dw.t = bw.t)::INT AS same
  FROM diagonals g JOIN bw USING (item_id) JOIN dw ON dw.doc_id = g.doc_id AND dw.p = bw.p + g.shift),
summed AS (
  SELECT doc_id, item_id, n,
    sum(same) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p ROWS BETWEEN n - 1 PRECEDING AND CURRENT ROW) AS matched,
    count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p ROWS BETWEEN n - 1 PRECEDING AND CURRENT ROW) AS words
  FROM aligned)
SELECT doc_id, item_id, max(n)::INT AS window_words, max(matched)::INT AS matched_words
FROM summed WHERE words = n AND matched >= n - CASE WHEN n < 8 THEN 0 ELSE floor(n * 0.2 + 1e-9) END GROUP BY doc_id, item_id
"""
