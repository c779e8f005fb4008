"""Line dedup: range-partitioned line hashes, streamed first occurrences, keep bitmaps per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.plans.lineage import cut, read

#: What is stripped at both ends of a line.
STRIP = " \t\n\v\f\r"
#: A line in every document is dealt out by document to so many runs.
SALTS = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: F.Column) -> F.Column:
    return F.translate(F.btrim(line, F.lit(STRIP)), UPPER, LOWER)


def text_lines(text: F.Column) -> F.Column:
    """The lines of a text; null or empty is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash that tells apart repeated rows of one doc_id with different texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id"), text.alias("text"), F.xxhash64(text).alias("row_hash"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, salts: int = SALTS, partitions: int | None = None) -> DataFrame:
    """Which lines of each document stay, as a run-length compressed bitmap; no text is returned.

    A key is a line stripped of ASCII blanks and lower-cased in A-Z. Keys of at
    least ``min_chars`` code points in at least ``min_docs`` documents lose all
    lines but those in the largest doc_id that holds them. Returns, only for
    documents that lose a line, ``doc_id, row_hash, dropped, runs``: the bitmap's
    runs of dropped lines, sorted, each with its start and size; all else stays.

    Lines are hashed and dealt to ranges of the hash of (key, salt of the
    document), whose bounds are known as hashes are uniform, so no pass samples
    them; ranges are sorted by document, largest first, and position. A window
    streams over each sorted run: its first row is the run's first occurrence,
    the rank of its last is the run's number of documents. Runs, not lines, are
    then summed per hash, so a line in every document costs ``salts`` rows there
    and its lines are spread over the ranges; the verdict goes back to runs,
    again by (hash, salt). Hashes are 128 bits: two keyed 64-bit hashes.

    Rows with one doc_id count as one document; null is a document of its own,
    below all others. Null text is one empty line. Ties don't arise: equal keys
    in one document share its fate. No rows give no rows.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = ("h1", "h2", "salt")
    place = F.shiftrightunsigned(F.xxhash64(*run), 33)
    keyed = (
        _identified(docs)
        .select("doc_id", "row_hash", F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .select("doc_id", "row_hash", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "row_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key", F.lit(11)).alias("h2"))
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        .withColumn("range", F.shiftright(place * n, 31).cast("int"))
    )
    order = (F.col("doc_id").desc_nulls_last(), F.col("pos"))
    lines = keyed.repartitionById(n, F.col("range")).sortWithinPartitions("range", *run, *order)
    # Ranks and first occurrences in one pass over each sorted run.
    lines = cut(lines.withColumn("nth", F.dense_rank().over(Window.partitionBy("range", *run).orderBy(F.col("doc_id").desc_nulls_last()))).drop("range"))
    heads = lines.groupBy(*run).agg(F.max("nth").alias("docs"), F.max("doc_id").alias("last"))
    verdicts = heads.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("last").alias("keeper"), F.collect_set("salt").alias("salts"))
    verdicts = verdicts.where(F.col("docs") >= min_docs).select("h1", "h2", "keeper", F.explode("salts").alias("salt"))
    lost = lines.join(verdicts, list(run)).where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "row_hash", "pos")
    return runs_of(lost, "doc_id", "row_hash")


def runs_of(lost: DataFrame, *keys: str) -> DataFrame:
    """Keys, ``dropped`` and ``runs`` (sorted starts and sizes) of rows (keys, pos). Repeated rows count once."""
    step = F.col("pos") - F.dense_rank().over(Window.partitionBy(*keys).orderBy("pos"))
    runs = lost.withColumn("step", step).groupBy(*keys, "step").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    run = F.struct("start", (F.col("end") - F.col("start") + 1).alias("size"))
    return runs.groupBy(*keys).agg(F.sum(run["size"]).alias("dropped"), F.array_sort(F.collect_list(run)).alias("runs"))


def apply_runs(df: DataFrame, lines: str, runs: str, out: str) -> DataFrame:
    """``df`` with ``out``: the lines (column) that a bitmap of ``runs_of`` (column) keeps; a null bitmap keeps all.

    Each kept stretch is one slice, so the work follows the lines, not their square.
    """
    last = F.element_at(runs, -1)
    before = F.transform(runs, lambda x, i: F.struct((F.when(i > 0, F.get(runs, i - 1)["start"] + F.get(runs, i - 1)["size"]).otherwise(0) + 1).alias("at"), x["start"].alias("end")))
    pieces = F.concat(before, F.array(F.struct((last["start"] + last["size"] + 1).alias("at"), F.size(lines).alias("end"))))
    some = df.withColumn("_pieces", F.when(F.col(runs).isNotNull(), pieces))
    kept = F.flatten(F.transform("_pieces", lambda x: F.slice(lines, x["at"], x["end"] - x["at"] + 1)))
    return some.withColumn(out, F.when(F.col("_pieces").isNull(), F.col(lines)).otherwise(kept)).drop("_pieces")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Each document's row with ``lines``, ``kept`` (arrays) and ``dropped`` besides doc_id, text and row_hash.

    The bitmaps meet the texts on (doc_id, row_hash). They are the side that is
    hashed, so texts stream by unsorted: a run takes 8 bytes for a line of
    ``min_chars`` or more, so a partition's bitmaps are a fraction of its texts.
    """
    bitmaps = keep_bitmaps(docs, min_chars, min_docs).withColumnsRenamed({"doc_id": "bitmap_id", "row_hash": "bitmap_hash"})
    own = _identified(docs)
    same = own.doc_id.eqNullSafe(bitmaps.bitmap_id) & (own.row_hash == bitmaps.bitmap_hash)
    both = own.join(bitmaps.hint("shuffle_hash"), same, "left").withColumn("lines", text_lines(F.col("text")))
    return apply_runs(both, "lines", "runs", "kept").select("doc_id", "text", "row_hash", "lines", F.coalesce("dropped", F.lit(0)).alias("dropped"), "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.col("dropped").cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"),
    )


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AND k.doc_id <> h.keeper AS gone FROM keyed k LEFT JOIN hot h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
