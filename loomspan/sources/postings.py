"""Text indexes as Parquet: postings by term and count, and exact top-k search that skips blocks which can't reach the k-th rank."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.retrieval import FIELD_WEIGHTS, _accepts, _terms_of, cover_density, parse_query, placed_terms
from loomspan.plans.lineage import cut

#: Folders of postings by hash of the term: readers take the number that the index was built with.
BUCKETS = 64


@dataclass(frozen=True)
class Top:
    """The first k rows (key, rank), and how many of the query's blocks, and of their postings, were read for them."""

    rows: DataFrame
    blocks_read: int
    blocks: int
    postings_read: int
    postings: int


@dataclass(frozen=True)
class _Block:
    term: str
    level: int
    rows: int
    most: float
    low: float
    top: float


@dataclass
class PostingIndex:
    """Postings of documents below ``path``: a row a term and document, in folders by bucket of the term and level of its count.

    A level holds counts from 2**level to below 2**(level + 1). A block is what
    a term has in a level; ``blocks`` keeps its rows, the largest sum of a
    document's field weights, and the least and largest weight. A document gives all postings of a term in one row, so nothing
    is grouped to build the index; rows are dealt by bucket and level in parts of
    an even size, so that a term in all documents is spread over many files.
    """

    spark: SparkSession
    path: str
    key: str = "id"
    fields: dict[str, float] = field(default_factory=lambda: dict(FIELD_WEIGHTS))
    buckets: int = BUCKETS

    def build(self, docs: DataFrame) -> None:
        """Write the index of documents with distinct keys; documents without a key are left out, null fields are empty.

        A repeated key is an error: the bounds of blocks hold for one document a key.
        """
        known = docs.where(F.col(self.key).isNotNull())
        if not known.groupBy(self.key).count().where("count > 1").isEmpty():
            raise ValueError(f"{self.key} must be distinct")
        key, buckets, names, weights = self.key, self.buckets, list(self.fields), list(self.fields.values())

        def run(batches):
            for batch in batches:
                source, rows = [], []
                for i, texts in enumerate(zip(*(batch.column(k + 1).to_pylist() for k in range(len(names))), strict=True)):
                    found: dict[str, tuple[list[int], list[float]]] = {}
                    for pos, of, term in placed_terms(texts):
                        at, by = found.setdefault(term, ([], []))
                        at.append(pos)
                        by.append(weights[of])
                    source += [i] * len(found)
                    rows += [(term, at, by, zlib.crc32(term.encode()) % buckets, len(at).bit_length() - 1) for term, (at, by) in found.items()]
                kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.int32(), pa.int32())
                columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int64())), *columns], [key, "term", "positions", "weights", "bucket", "level"])

        texts = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in names]
        kind = docs.schema[self.key].dataType.simpleString()
        rows = known.select(self.key, *texts).mapInArrow(run, f"{self.key} {kind}, term string, positions array<int>, weights array<double>, bucket int, level int")
        dealt = rows.hint("rebalance", F.col("bucket"), F.col("level")).sortWithinPartitions("bucket", "level", "term")
        dealt.write.mode("overwrite").partitionBy("bucket", "level").parquet(f"{self.path}/postings")
        # Read with its schema: an empty table writes no partition to infer it from.
        figures = self._postings(kind).groupBy("bucket", "term", "level").agg(F.count("*").alias("rows"), F.max(F.aggregate("weights", F.lit(0.0), lambda s, w: s + w)).alias("most"), F.min(F.array_min("weights")).alias("low"), F.max(F.array_max("weights")).alias("top"))
        figures.sort("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/blocks")
        self.spark.createDataFrame([], f"{self.key} {kind}").write.mode("overwrite").parquet(f"{self.path}/key")

    def _postings(self, kind: str | None = None) -> DataFrame:
        kind = kind or self.spark.read.parquet(f"{self.path}/key").schema[self.key].dataType.simpleString()
        return self.spark.read.schema(f"{self.key} {kind}, term string, positions array<int>, weights array<double>, bucket int, level int").parquet(f"{self.path}/postings")

    def _of(self, df: DataFrame, terms: set[str]) -> DataFrame:
        return df.where(F.col("bucket").isin(*sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})) & F.col("term").isin(*sorted(terms)))

    def postings(self, terms: set[str], least: int = 0) -> DataFrame:
        """The postings of terms from a level on; only their folders are listed for the scan."""
        return self._of(self._postings(), terms).where(F.col("level") >= least)

    def top(self, query: str, k: int) -> Top:
        """The k best documents of a web-style query by cover density, ties by key: those that ``search_index`` puts first.

        Stretches that satisfy a query are shortest from their ends, and no two
        begin or end at the same place. So an occurrence of a condition lies in
        at most one that begins with it, and for every other condition in as many
        as its phrase is long. A stretch within a field is worth no more than the
        field's weight, so a document has at most that many times the sum of the
        weights of a needed lexeme, and as many stretches again, of the largest
        weight, over each border of fields; nor more than that many times the
        largest weight for each time that the lexeme occurs. From the highest level down, levels are
        added until the k-th rank is above what any document can have that has a
        needed lexeme in a level not read. A step scans the levels again, of
        which each holds more rows than those above it as a rule.

        Negated lexemes are read whole, and so is a query of alternatives, whose
        documents need not hold all its lexemes. A query without words to find
        gives nothing. At most 31 figures a lexeme and k rows' least rank reach
        the driver.
        """
        parsed = parse_query(query)
        needed = _terms_of(parsed, False)
        if not needed or k < 1:
            return Top(self._postings().limit(0).select(self.key, F.lit(0.0).alias("rank")), 0, 0, 0, 0)
        others = _terms_of(parsed, True) - needed
        figures = self._of(self.spark.read.schema("term string, level int, rows long, most double, low double, top double, bucket int").parquet(f"{self.path}/blocks"), needed | others)
        every = [_Block(r["term"], r["level"], r["rows"], r["most"], r["low"], r["top"]) for r in figures.drop("bucket").collect()]
        blocks = [b for b in every if b.term in needed]
        together = needed if len(parsed) == 1 else set()
        levels = sorted({b.level for b in blocks}, reverse=True) or [0]
        if not together:
            levels = levels[-1:]
        bounds = _bounds(parsed[0], blocks, levels, len(self.fields))
        held = [min(sum(b.rows for b in blocks if b.term == t and b.level >= low) for t in needed) for low in levels]
        at = next((n for n, rows in enumerate(held) if rows >= k), len(levels) - 1)
        while True:
            rows = self.postings(needed, levels[at])
            if others:
                rows = rows.unionByName(self.postings(others))
            found = cut(_ranked(rows, parsed, together, self.key).orderBy(F.desc("rank"), self.key).limit(k))
            n, last = found.agg(F.count("*"), F.min("rank")).first()
            # Ranks are rounded to six places.
            enough = [m for m, bound in enumerate(bounds) if n == k and bound + 1e-6 < last]
            if at == len(levels) - 1 or at in enough:
                break
            at = next((m for m in enough if m > at), at + 1)
        read = [b for b in every if b.term in others or b.level >= levels[at]]
        return Top(found, len(read), len(every), sum(b.rows for b in read), sum(b.rows for b in every))


def _bounds(conditions: list, blocks: list[_Block], levels: list[int], fields: int) -> list[float]:
    """For each level, what a document can rank at most that has a needed lexeme below it; below the last level there are none."""
    wanted = [placed for minus, placed in conditions if not minus]
    reach = sum(1 + placed[-1][0] - placed[0][0] for placed in wanted)
    single = len(wanted) == 1 and len(wanted[0]) == 1
    one_weight = len({w for b in blocks for w in (b.low, b.top)}) <= 1
    across = 0.0 if single or one_weight else (fields - 1) * max((b.top for b in blocks), default=0.0)
    heaviest = max((b.top for b in blocks), default=0.0)
    most = [(b.level, reach * (b.most if single else min(b.most + across, heaviest * (2 ** (b.level + 1) - 1)))) for b in blocks]
    return [max((m for level, m in most if level < low), default=0.0) for low in levels]


def _ranked(rows: DataFrame, parsed: list, together: set[str], key: str) -> DataFrame:
    """key, rank of the documents that match, from their postings; those without all of ``together`` go before Python."""
    positive = _terms_of(parsed, False)
    held = F.count_if(F.col("term").isin(*sorted(together))) if together else F.lit(0)
    grouped = rows.groupBy(key).agg(F.collect_list(F.struct("term", "positions", "weights")).alias("_rows"), held.alias("_held")).where(F.col("_held") == len(together))

    def run(batches):
        for batch in batches:
            ranks = []
            for listed in batch.column(1).to_pylist():
                places = sorted((p, w, r["term"]) for r in listed for p, w in zip(r["positions"], r["weights"], strict=True))
                at: dict[str, list[int]] = {}
                for p, _, t in places:
                    at.setdefault(t, []).append(p)
                ranks.append(round(cover_density(parsed, [x for x in places if x[2] in positive]), 6) if _accepts(parsed, at) else None)
            kept = pa.array(ranks, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), kept], [key, "rank"]).filter(kept.is_valid())

    return grouped.select(key, "_rows").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, rank double")
