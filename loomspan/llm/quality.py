"""Quality classifier: Bradley-Terry scores from preference pairs, thresholded at a quantile."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomspan.llm.kernel import BLANK, LOWER, Splitter, chunks, mapped, split, texts
from loomspan.plans.lineage import read

#: Bounds of what is learned from: labelled rows whose features reach the driver, and pairs drawn from them.
MAX_LABELLED, MAX_PAIRS = 20_000, 100_000
#: The score at the threshold quantile.
AT_THRESHOLD = 0.3
_WORDS = Splitter(BLANK, LOWER, seed=5)
_MARKS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_CLASS = np.zeros(256, np.int64)
_CLASS[_MARKS] = np.arange(len(_MARKS)) + 1
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def features(data: np.ndarray, offsets: np.ndarray, tables=None) -> np.ndarray:
    """Features of each text, of its bytes and words alone; an empty text has all zeros.

    Shares of capitals, digits, blanks, line ends and each ASCII mark; word
    length; shares of words that repeat the word before, that end in a mark,
    that hold no letter, and that are distinct; and the largest shares of marks,
    capitals and repeats over the lines with five words or more.
    """
    n = len(offsets) - 1
    w = split(data, offsets, _WORDS, tables)
    words = np.diff(w.first)
    size = np.diff(offsets)
    out = np.zeros((n, 13 + len(_MARKS)))
    if not len(w.starts):
        return out
    doc_of_byte = np.repeat(np.arange(n), size)
    per = np.maximum(size, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc_of_byte[mask], minlength=n) / per

    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = share(_UPPER[data]), share(_DIGIT[data]), share(BLANK[data]), share(data == 10)
    marks = np.flatnonzero(_CLASS[data])
    out[:, 13:] = np.sqrt(np.bincount(doc_of_byte[marks] * len(_MARKS) + _CLASS[data[marks]] - 1, minlength=n * len(_MARKS)).reshape(n, -1) / per[:, None])
    doc = np.repeat(np.arange(n), words)
    count = np.maximum(words, 1)
    repeat = np.zeros(len(doc))
    repeat[1:] = (w.hashes[1:] == w.hashes[:-1]) & (doc[1:] == doc[:-1])
    sums = lambda x: np.bincount(doc, x, minlength=n)
    out[:, 4] = sums(w.ends - w.starts) / count / 10
    out[:, 5] = sums(repeat) / count
    ends_in_mark = (_CLASS[data[w.ends - 1]] > 0).astype(float)
    out[:, 6] = sums(ends_in_mark) / count
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    bare = (letters[w.ends] == letters[w.starts]).astype(float)
    out[:, 7] = sums(bare) / count
    distinct = [len(np.unique(w.hashes[a:b])) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    out[:, 8] = np.array(distinct) / np.sqrt(count * np.maximum(count, 100.0))
    out[:, 9] = np.log1p(words) / 10
    line = np.cumsum(data == 10)[w.starts]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(fresh)
    length = np.diff(begin, append=len(doc))
    capitals = np.concatenate([[0], np.cumsum(_UPPER[data])])
    own = (capitals[w.ends] - capitals[w.starts]) / (w.ends - w.starts)
    for k, x in ((10, ends_in_mark + bare), (11, own), (12, repeat)):
        value = np.where(length >= 5, np.add.reduceat(x, begin) / length, 0)
        np.maximum.at(out[:, k], doc[begin], value)
    return out


@dataclass(frozen=True)
class Ranker:
    """A linear score of standardised features, and the raw score at the threshold quantile."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, AT_THRESHOLD at the quantile."""
        s = self.raw(x) - self.threshold + np.log(AT_THRESHOLD / (1 - AT_THRESHOLD))
        return np.where(s >= 0, 1 / (1 + np.exp(-np.abs(s))), np.exp(-np.abs(s)) / (1 + np.exp(-np.abs(s))))


def bradley_terry(x: np.ndarray, y: np.ndarray, steps: int = 300, penalty: float = 1e-3, seed: int = 5) -> Ranker:
    """Fit by logistic loss on differences: P(a is preferred to b) = sigmoid(w . (a - b)), a of label 1 and b of label 0.

    Pairs are drawn with a fixed seed. The threshold is the quantile of all
    training scores at the share of label 0. One class alone, or no rows, gives
    a constant score of 1/2 (everything is taken).
    """
    d = x.shape[1]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(d), np.ones(d), np.zeros(d), float(np.log(AT_THRESHOLD / (1 - AT_THRESHOLD))))
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    n = min(MAX_PAIRS, 20 * max(len(good), len(bad)))
    a, b = rng.choice(good, n), rng.choice(bad, n)
    w, m, v = np.zeros(d), np.zeros(d), np.zeros(d)
    for t in range(1, steps + 1):
        part = rng.integers(0, n, min(n, 4096))
        diff = z[a[part]] - z[b[part]]
        g = -(diff / (1 + np.exp(np.clip(diff @ w, -30, 30)))[:, None]).mean(0) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    raw = z @ w
    return Ranker(mean, scale, w, float(np.quantile(raw, len(bad) / len(y))))


def remainder(doc_id: F.Column) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def _featured(df: DataFrame) -> DataFrame:
    """doc_id, quality, x (features as doubles in bytes)."""

    def run(batches):
        tables = _WORDS.tables()
        for batch in batches:
            data, offsets = texts(batch.column(2))
            rows = []
            for i, j in chunks(offsets):
                rows += [r.tobytes() for r in features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tables)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "quality", "x"])

    return mapped(df.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), F.col("text").cast("string")), run, "doc_id long, quality int, x binary")


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Ranker:
    """Learn from labelled rows outside the held-out fold; of more than ``max_labelled``, those with the least hashes of doc_id.

    Labels with a null doc_id or quality are ignored; of repeated labels of a
    document the largest counts, of the texts of a repeated doc_id the one with the least features.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.where(remainder(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    featured = _featured(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    # At most max_labelled rows.
    rows = featured.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("r")).select("r.x", "r.quality").collect()
    rows.sort(key=lambda r: (r["x"], r["quality"]))
    d = 13 + len(_MARKS)
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float64).reshape(-1, d)
    return bradley_terry(x, np.array([r["quality"] for r in rows], np.int64))


def score_documents(docs: DataFrame, model: Ranker) -> DataFrame:
    """``docs`` with a column ``quality_score`` of its texts; map-side only, other columns pass through.

    Null text is scored as empty. Each row is scored by its text alone, so
    equal texts have equal scores. A column of that name is replaced.
    """
    others = [c for c in docs.columns if c != "quality_score"]
    source = docs.select(*others)
    schema = StructType([*source.schema.fields, StructField("quality_score", DoubleType())])
    at = others.index("text")

    def run(batches):
        tables = _WORDS.tables()
        for batch in batches:
            data, offsets = texts(batch.column(at))
            scores = [np.zeros(0)]
            for i, j in chunks(offsets):
                scores.append(model.score(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tables)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores), pa.float64())], [*others, "quality_score"])

    return mapped(source, run, schema)


def op5_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score_documents(docs.select("doc_id", "text"), learn(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id")) == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= AT_THRESHOLD).cast("int").alias("predicted"),
    )
