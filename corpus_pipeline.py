"""A corpus pipeline of five operators: quality, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
documents: doc_id, text, lang, source, n_chars. ``run`` applies them in order,
each to what the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import bpe, decontaminate, lines, quality, sketches
from loomspan.plans.lineage import cut, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Bradley-Terry score reaches the threshold stay, unchanged.

    Each row is judged by its text alone: a null text as an empty one, repeated
    rows and null ids like all others. No rows give no rows; columns beside
    those of documents go.
    """
    model = quality.learn(docs, read(spark, sf_dir, "labels"))
    return quality.score_documents(docs.select(*COLUMNS), model).where(F.col("quality_score") >= quality.AT_THRESHOLD).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in five documents or more stay in the last of them only; a text that loses none is unchanged."""
    bitmaps = lines.keep_bitmaps(docs).select(F.col("doc_id").alias("bitmap_id"), F.col("row_hash").alias("bitmap_hash"), "runs")
    own = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash"))
    same = own.doc_id.eqNullSafe(bitmaps.bitmap_id) & (own.row_hash == bitmaps.bitmap_hash)
    both = lines.apply_runs(own.join(bitmaps.hint("shuffle_hash"), same, "left").withColumn("_lines", lines.text_lines(F.col("text"))), "_lines", "runs", "_kept")
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n"))
    return both.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``gone`` names by doc_id and row_hash, a hash of the text."""
    own = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash"))
    return own.join(gone.select("doc_id", "row_hash").distinct(), ["doc_id", "row_hash"], "left_anti").select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by sets of five-word shingles at 80 % similarity, the document with the least doc_id stays.

    Rows go by doc_id and text, so of a repeated doc_id only linked texts do; null ids are in no group.
    """
    return without(docs, sketches.near_duplicate_groups(docs, shingle=5, percent=80).where(~F.col("kept") & F.col("doc_id").isNotNull()))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a benchmark passage go; rows with a null doc_id are not tested and stay."""
    return without(docs, decontaminate.contaminated_rows(docs, read(spark, sf_dir, "benchmark")))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text.

    A row each, also of null and repeated ids; a null text is empty and has no
    tokens. No rows give no rows.
    """
    return bpe.encode_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE", encode_stage),
]

#: The trained classifier can't be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
