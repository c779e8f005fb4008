"""Substring dedup: difference-cover anchors, aligned in any long match, then extended to whole windows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.filters import bit_of, flags, is_set
from loomspan.llm.kernel import BLANK, Splitter, chunks, mapped, signed, split, texts, windows, within
from loomspan.plans.lineage import cut, read

#: A perfect difference set: every residue modulo the period is a difference of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
_WORDS = (Splitter(BLANK, seed=8), Splitter(BLANK, seed=88))


def is_difference_cover(period: int, cover: tuple[int, ...]) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def anchor_size(window: int, period: int) -> int:
    """Words of an anchor such that any window holds an aligned one: offsets 0 to period - 1 and the anchor fit into it."""
    if window < period:
        raise ValueError("a window must have at least as many words as the period")
    return window - period + 1


def _anchors(first: np.ndarray, hashes: np.ndarray, size: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Word indices at which an anchor begins, and the anchors' hashes."""
    at = within(first, size)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    inside = np.zeros(period, bool)
    inside[list(cover)] = True
    of = np.repeat(first[:-1], np.diff(first))
    at = at[inside[(at - of[at]) % period]]
    return at, windows(hashes, size)[at]


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("row_hash"))


def _groups(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key and document, and each row's group's least and largest document, in that order."""
    order = np.lexsort((doc, keys))
    k, d = keys[order], doc[order]
    if not len(k):
        return order, d, d
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(start, append=len(k))
    return order, np.repeat(d[start], size), np.repeat(d[start + size - 1], size)


def _by_row(row: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the chosen values in order of row: a document's are neighbours in the shuffle, where its id is stored once."""
    at = np.flatnonzero(which)
    return at[np.argsort(row[at], kind="stable")]


def _packed(row: np.ndarray, values: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
    """The distinct rows and the list of each one's values, of values in order of row."""
    new = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])[: len(row)])
    return row[new], pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), values)


def _both(batch: pa.RecordBatch, row: np.ndarray, columns: list[pa.Array], settled_row: np.ndarray, settled: pa.ListArray, names: list[str]) -> pa.RecordBatch:
    """One batch of unsettled rows, with null lists, then a row of each document with settled ones, with nulls elsewhere.

    The first column deals the rows out: a settled row goes by its document,
    so that no common anchor or window gathers them.
    """
    ids, hashes = (batch.column(k).take(pa.array(np.concatenate([row, settled_row]))) for k in (0, 1))
    n, m = len(row), len(settled_row)
    by = hashes.slice(n).to_numpy().view(np.uint64) + ids.slice(n).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = [ids, hashes, pa.concat_arrays([columns[0], signed(by)])]
    out += [pa.concat_arrays([c, pa.nulls(m, c.type)]) for c in columns[1:]]
    return pa.RecordBatch.from_arrays([*out, pa.concat_arrays([pa.nulls(n, settled.type), settled])], names)


def _anchor_rows(rows: DataFrame, size: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """Distinct anchors of documents, combined within each batch, all from one pass over it.

    Anchors that two documents of the batch hold need no further search: each
    document has them in ``settled`` of a row of its own. The others have a row
    each; so has each settled anchor once, of the batch's least document, with
    ``known``.
    """
    names = ["doc_id", "row_hash", "anchor", "known", "settled"]

    def run(batches):
        tables = _WORDS[0].tables()
        for batch in batches:
            data, offsets = texts(batch.column(2))
            ids = batch.column(0).to_numpy()
            found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
            for i, j in chunks(offsets):
                w = split(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], _WORDS[0], tables)
                at, anchors = _anchors(w.first, w.hashes, size, period, cover)
                found.append((np.searchsorted(w.first, at, "right") - 1 + i, anchors))
            row, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
            order, low, high = _groups(anchor, ids[row])
            row, anchor, known = row[order], anchor[order], low < high
            own = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])[: len(row)]
            single = np.concatenate([[True], anchor[1:] != anchor[:-1]])[: len(row)] | (~known & own)
            held, single = _by_row(row, known & own), _by_row(row, single)
            yield _both(batch, row[single], [signed(anchor[single]), pa.array(known[single])], *_packed(row[held], signed(anchor[held])), names)

    return mapped(rows.where("doc_id is not null").select("doc_id", "row_hash", "text"), run, "doc_id long, row_hash long, anchor long, known boolean, settled array<long>")


def _window_rows(found: DataFrame, window: int, size: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """Windows around the anchors that a document shares, combined within each batch, all from one pass over it.

    Windows that also start in a smaller document of the batch are removed
    whatever the others hold: a document has their starts in ``settled`` of a
    row of its own. The rest have a row each, with w1 and w2: 128-bit
    fingerprints.
    """
    names = ["doc_id", "row_hash", "w1", "w2", "start", "settled"]

    def run(batches):
        tables = [s.tables() for s in _WORDS]
        for batch in batches:
            data, offsets = texts(batch.column(2))
            ids, shared = batch.column(0).to_numpy(), batch.column(3)
            found_ = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
            for k in range(batch.num_rows):
                part = data[offsets[k] : offsets[k + 1]]
                one = np.array([0, len(part)])
                w = split(part, one, _WORDS[0], tables[0])
                last = len(w.hashes) - window
                if last < 0:
                    continue
                at, anchors = _anchors(w.first, w.hashes, size, period, cover)
                known = np.asarray(shared[k].values.to_numpy(zero_copy_only=False)).view(np.uint64)
                at = at[np.isin(anchors, known)]
                # An anchor at i lies in the windows that start at i - period + 1 to i.
                mark = np.zeros(len(w.hashes) + 1, np.int64)
                np.add.at(mark, np.maximum(at - period + 1, 0), 1)
                np.add.at(mark, at + 1, -1)
                starts = np.flatnonzero(np.cumsum(mark)[: last + 1] > 0)
                w2 = windows(split(part, one, _WORDS[1], tables[1]).hashes, window)[starts]
                found_.append((np.full(len(starts), k), starts, windows(w.hashes, window)[starts], w2))
            row, start, w1, w2 = (np.concatenate(x) for x in zip(*found_, strict=True))
            # Both fingerprints as one: equal pairs are equal sums of odd multiples but for a chance of 2**-64 a pair.
            order, low, _ = _groups(w1 + w2 * np.uint64(0x9E3779B97F4A7C15), ids[row])
            row, start, w1, w2 = row[order], start[order].astype(np.int32), w1[order], w2[order]
            later = ids[row] > low
            held, first = _by_row(row, later), _by_row(row, ~later)
            columns = [signed(w1[first]), signed(w2[first]), pa.array(start[first])]
            yield _both(batch, row[first], columns, *_packed(row[held], pa.array(start[held])), names)

    return mapped(found.select("doc_id", "row_hash", "text", "anchors"), run, "doc_id long, row_hash long, w1 long, w2 long, start int, settled array<int>")


def _gathered(judged: DataFrame, column: str, name: str, distinct: bool) -> DataFrame:
    """doc_id, row_hash and the list of a document's settled and judged values; nulls are in neither."""
    own = (F.collect_set if distinct else F.collect_list)(column)
    return judged.groupBy("doc_id", "row_hash").agg(F.concat(own, F.flatten(F.collect_list("settled"))).alias(name))


def shared_anchors(rows: DataFrame, size: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """doc_id, row_hash, anchors: the anchors of each document that another document holds as well."""
    # A batch sends an anchor once, so a group has a row a batch at most, however many documents hold the anchor.
    w = Window.partitionBy("anchor")
    judged = _anchor_rows(rows, size, period, cover).repartition("anchor").withColumns({"low": F.min("doc_id").over(w), "high": F.max("doc_id").over(w)})
    across = judged.where("settled is not null or (low < high and not known)")
    return _gathered(across.withColumn("anchor", F.when(F.col("settled").isNull(), F.col("anchor"))), "anchor", "anchors", False)


def repeated_windows(held: DataFrame, window: int, size: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """doc_id, row_hash, starts: the windows that also start in a document with a smaller doc_id.

    ``held`` comes out of a shuffle, whose fetch order is random. What a batch
    settles and what it leaves to the others are therefore one output of one
    pass, and rows are sorted first, so that a task that runs again after the
    loss of an executor forms the same batches.
    """
    passed = _window_rows(held.sortWithinPartitions("doc_id", "row_hash"), window, size, period, cover)
    first = F.first("doc_id").over(Window.partitionBy("w1", "w2").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    across = passed.repartition("w1").withColumn("low", first).where("settled is not null or doc_id > low")
    return _gathered(across, "start", "starts", True)


def _candidates(rows: DataFrame, known, size: int) -> tuple[DataFrame, DataFrame]:
    """rows that share an anchor (with a few that don't), and the others, those with null ids too: by a filter, map-side."""

    def part(inside: bool):
        def run(batches):
            bits = known.value
            for batch in batches:
                key = batch.column(3).to_numpy()
                on = is_set(bits, key) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(on if inside else ~on)).select([0, 1, 2])

        return mapped(rows.select("doc_id", "row_hash", "text", bit_of(size, "doc_id", "row_hash").alias("bit")), run, "doc_id long, row_hash long, text string")

    # Both joins of the first meet the same filter, which an inner join adds by itself, so that they read one shuffle.
    return part(True).where("doc_id is not null and row_hash is not null"), part(False)


_KEPT = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"


def dedup_substrings(docs: DataFrame, window: int = 50, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """Every document without the words of windows that also start in a document with a smaller doc_id.

    Returns ``doc_id, n_words, n_removed, kept, kept_sha256``; ``kept`` is the
    remaining words joined by one space. A window is a run of ``window`` words,
    and windows are judged on the input.

    Only words at cover positions modulo the period begin an anchor, a shorter
    window that is hashed: for any two places some shift below the period brings
    both to cover positions, so two equal windows always share an aligned
    anchor. Anchors are combined in each batch, then grouped by hash. Documents
    that share none are done. The others meet their shared anchors, and each
    anchor extends to all windows that hold it; these carry 128-bit fingerprints,
    are combined in each batch again, and of each fingerprint the document with
    the least doc_id keeps its windows. Each of the two searches is one pass
    over its batches, so the order of rows plays no part; only an input that is
    itself read in another order when a lost task runs again should be
    checkpointed first.

    Nulls: a null text has no words; a row with a null doc_id neither removes
    nor loses anything. Rows that repeat a doc_id count as one document, so they
    never remove from one another, and each is judged by its own text. Texts
    shorter than a window have none. No rows give no rows; other columns are
    ignored.
    """
    if not is_difference_cover(period, cover):
        raise ValueError("the cover does not reach every difference")
    size = anchor_size(window, period)
    rows = _rows(docs)
    found = cut(shared_anchors(rows, size, period, cover))
    bits, size_ = flags(found, "doc_id", "row_hash")
    near, far = _candidates(rows, docs.sparkSession.sparkContext.broadcast(bits), size_)
    # The lists are the side that is hashed, so texts stream by unsorted: 8 bytes an anchor and 4 a window's start, of as many words' texts.
    held = near.join(found.hint("shuffle_hash"), ["doc_id", "row_hash"])
    gone = repeated_windows(held, window, size, period, cover).withColumnsRenamed({"doc_id": "gone_id", "row_hash": "gone_hash"})
    both = near.join(gone.hint("shuffle_hash"), (near.doc_id == gone.gone_id) & (near.row_hash == gone.gone_hash), "left").select("doc_id", "text", "starts")
    return _kept(both.unionByName(far.select("doc_id", "text", F.lit(None).cast("array<int>").alias("starts"))), window)


def _kept(both: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, offsets = texts(batch.column(1))
            raw = data.tobytes()
            counts, removed, kept, digests = [], [], [], []
            for k in range(batch.num_rows):
                words = raw[offsets[k] : offsets[k + 1]].split()
                starts = batch.column(2)[k]
                gone = 0
                left = words
                if starts.is_valid:
                    mark = np.zeros(len(words) + 1, np.int64)
                    at = starts.values.to_numpy(zero_copy_only=False)
                    np.add.at(mark, at, 1)
                    np.add.at(mark, at + window, -1)
                    cover_ = np.cumsum(mark)[:-1] > 0
                    gone = int(cover_.sum())
                    left = [words[i] for i in np.flatnonzero(~cover_)]
                text = b" ".join(left)
                counts.append(len(words))
                removed.append(gone)
                kept.append(text)
                digests.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())],
                [f.split()[0] for f in _KEPT.split(", ")],
            )

    return mapped(both.select("doc_id", "text", "starts"), run, _KEPT)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read(spark, sf_dir, "documents")).drop("kept")


OP8_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 49)) AS s, w FROM words WHERE len(w) >= 50),
spans AS (
  SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') AS span FROM starts),
hashed AS (SELECT doc_id, s, md5(span) AS h FROM spans),
least AS (SELECT h, min(doc_id) AS low FROM hashed GROUP BY h HAVING min(doc_id) < max(doc_id)),
removed AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 49)) AS p FROM hashed JOIN least USING (h) WHERE doc_id > low),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM removed GROUP BY doc_id),
each AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM words),
kept AS (
  SELECT e.doc_id, string_agg(e.w[e.p], ' ' ORDER BY e.p) AS t
  FROM each e ANTI JOIN removed r ON e.doc_id = r.doc_id AND e.p = r.p GROUP BY e.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN gone g USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
