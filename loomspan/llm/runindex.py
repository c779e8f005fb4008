"""Suffix-array dedup: run-compressed Burrows-Wheeler indexes with sampled run ends, and matching statistics streamed from them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.filters import flags
from loomspan.llm.kernel import chunks, mapped, signed, texts, windows
from loomspan.llm.substrings import _both, _by_row, _candidates, _packed, _rows
from loomspan.plans.lineage import cut, read

#: Bytes of an anchor: a window is dealt out by the least hash of its anchors.
ANCHOR = 32
#: Bytes of texts that one index takes, whole anchors' texts together.
BLOCK = 1 << 20
#: Not a byte of UTF-8.
_END = 0xFF
_BYTES = np.random.default_rng(12).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: Bytes of a packed key: 9 bits each, as the end of the text is one more symbol.
_PACK = 7


def _packed_keys(text: np.ndarray) -> np.ndarray:
    symbols = np.concatenate([text.astype(np.int64) + 1, np.zeros(_PACK, np.int64)])
    key = np.zeros(len(text), np.int64)
    for k in range(_PACK):
        key = key << 9 | symbols[k : k + len(text)]
    return key


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes' starts in their order, by doubling; what is settled is not sorted again."""
    n = len(text)
    key = _packed_keys(text)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    size = _PACK
    while len(slots):
        at = order[slots]
        after = at + size
        key = rank[at] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        slots = slots[~(new & np.append(new[1:], True))]
        size *= 2
    return order


def _common(text: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at a and at b share at their start."""
    n, out = len(text), np.zeros(len(a), np.int64)
    left = np.flatnonzero(np.maximum(a, b) < n)
    while len(left) > 32:
        x, y = a[left] + out[left], b[left] + out[left]
        whole = (np.maximum(x, y) + _PACK <= n) & (key[np.minimum(x, n - 1)] == key[np.minimum(y, n - 1)])
        out[left[whole]] += _PACK
        rest = left[~whole]
        going = np.ones(len(rest), bool)
        for _ in range(_PACK):
            x, y = a[rest] + out[rest], b[rest] + out[rest]
            going &= (np.maximum(x, y) < n) & (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)])
            out[rest[going]] += 1
        left = left[whole]
    for i in left:
        x, y, step = int(a[i] + out[i]), int(b[i] + out[i]), 64
        while max(x, y) < n:
            m = min(step, n - max(x, y))
            differs = text[x : x + m] != text[y : y + m]
            if differs.any():
                out[i] += int(differs.argmax())
                break
            x, y, out[i], step = x + m, y + m, out[i] + m, min(2 * step, 1 << 16)
    return out


class RunIndex:
    """The Burrows-Wheeler transform of a text in runs, with the text's places sampled at the runs' ends.

    ``symbols`` and ``lengths`` are the runs; the symbol before the text's begin
    is -1. ``at`` are the places, ascending, of the suffixes at which a run
    begins; ``before`` the suffix just before each in the order, at which the
    last run ends (-1 for the first), and ``shared`` the bytes that the two have
    in common. Between samples both neighbours move on together, so all other
    places follow from these: memory is that of the runs.
    """

    def __init__(self, text: np.ndarray) -> None:
        n = len(text)
        order = np.append(n, suffix_order(text))  # the empty suffix is first
        symbol = text[order - 1].astype(np.int16) if n else np.zeros(1, np.int16)
        symbol[order == 0] = -1
        head = np.ones(n + 1, bool)
        head[1:] = symbol[1:] != symbol[:-1]
        first = np.flatnonzero(head)
        self.symbols, self.lengths = symbol[first], np.diff(first, append=n + 1)
        at, before = order[first], np.where(first > 0, order[first - 1], -1)
        shared = np.zeros(len(at), np.int64)
        shared[1:] = _common(text, _packed_keys(text), at[1:], before[1:])
        by = np.argsort(at)
        self.at, self.before, self.shared = at[by], before[by], shared[by]

    def statistics(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of the text's own places: length of the match with the neighbour in the order, and its place.

        Of equal strings all but one, the first in the order, have a neighbour
        that begins with it, so following sources joins all places of a string.
        """
        k = np.searchsorted(self.at, places, "right") - 1
        moved = places - self.at[k]
        return np.maximum(self.shared[k] - moved, 0), self.before[k] + moved

    def text(self) -> bytes:
        """The text, walked back from its end by last-to-first steps."""
        symbols = np.repeat(self.symbols, self.lengths)
        step = np.empty(len(symbols), np.int64)
        step[np.argsort(symbols, kind="stable")] = np.arange(len(symbols))
        out, row = [], 0
        while symbols[row] >= 0:
            out.append(int(symbols[row]))
            row = int(step[row])
        return bytes(out[::-1])


def _sliding(x: np.ndarray, span: int, least: bool) -> np.ndarray:
    """Least or largest of each run of ``span`` values."""
    op = np.minimum if least else np.maximum
    n, length = len(x) - span + 1, 1
    while 2 * length <= span:
        x = op(x[:-length], x[length:])
        length *= 2
    return op(x[:n], x[span - length : span - length + n])


def _dealt(data: np.ndarray, offsets: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of anchors at all places, the least of each window, and which windows lie in one text."""
    h = windows(_BYTES[data], anchor)
    least = _sliding(h, window - anchor + 1, True)
    end = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    return h, least, np.arange(len(least)) + window <= end


def _anchor_rows(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """Least anchors of windows, combined within each batch, all from one pass over it.

    An anchor that stands at two places of the batch needs no further search:
    each document has it in ``settled`` of a row of its own. All have one row a
    batch, with ``known``.
    """
    names = ["doc_id", "row_hash", "anchor", "known", "settled"]

    def run(batches):
        for batch in batches:
            data, offsets = texts(batch.column(2))
            found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
            for i, j in chunks(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if len(part) < window:
                    continue
                h, least, whole = _dealt(part, own, window, anchor)
                edge = np.zeros(window - anchor, np.uint64)
                # A place is an anchor if it is the least of a window around it.
                at = np.flatnonzero(_sliding(np.concatenate([edge, np.where(whole, least, np.uint64(0)), edge]), window - anchor + 1, False) == h)
                found.append((np.searchsorted(own, at, "right") - 1 + i, h[at]))
            row, value = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((row, value))
            row, value = row[order], value[order]
            new = np.concatenate([[True], value[1:] != value[:-1]])[: len(value)]
            first = np.flatnonzero(new)
            known = np.diff(first, append=len(value)) > 1
            own = (new | np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]) & np.repeat(known, np.diff(first, append=len(value)))
            held = _by_row(row, own)
            yield _both(batch, row[first], [signed(value[first]), pa.array(known)], *_packed(row[held], signed(value[held])), names)

    return mapped(rows.where("doc_id is not null").select("doc_id", "row_hash", "text"), run, "doc_id long, row_hash long, anchor long, known boolean, settled array<long>")


def shared_anchors(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """doc_id, row_hash, anchors: the least anchors of each document that stand at another place as well."""
    # A batch sends an anchor once, so a group has a row a batch at most, however many documents hold the anchor.
    judged = _anchor_rows(rows, window, anchor).repartition("anchor").withColumn("n", F.count("*").over(Window.partitionBy("anchor")))
    across = judged.where("settled is not null or (n > 1 and not known)").withColumn("anchor", F.when(F.col("settled").isNull(), F.col("anchor")))
    return across.groupBy("doc_id", "row_hash").agg(F.concat(F.collect_list("anchor"), F.flatten(F.collect_list("settled"))).alias("anchors"))


def _runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Runs of windows as one number each."""
    return start.astype(np.int64) << 32 | count


def _segment_rows(held: DataFrame, window: int, anchor: int) -> DataFrame:
    """Segments, the texts of runs of windows with the same least anchor, one of a kind in each batch.

    The others of a kind are later copies, whose windows go whatever other
    batches hold: they are in ``settled`` of a row of their document. Batches
    come sorted by document.
    """
    names = ["doc_id", "row_hash", "anchor", "start", "segment", "settled"]

    def run(batches):
        for batch in batches:
            data, offsets = texts(batch.column(2))
            ids, hashes, shared = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            seen: dict[bytes, tuple[int, int]] = {}
            row, value, start, segment, gone_row, gone = [], [], [], [], [], []
            for k in range(batch.num_rows):
                part = data[offsets[k] : offsets[k + 1]]
                if len(part) < window:
                    continue
                _, least, _ = _dealt(part, np.array([0, len(part)]), window, anchor)
                first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
                count = np.diff(first, append=len(least))
                on = np.isin(least[first], np.asarray(shared[k].values.to_numpy(zero_copy_only=False)).view(np.uint64))
                raw = part.tobytes()
                for s, c, v in zip(first[on].tolist(), count[on].tolist(), least[first[on]].tolist(), strict=True):
                    own = raw[s : s + c + window - 1]
                    key = xxhash.xxh3_128_digest(own)
                    r, at = seen.setdefault(key, (k, s))
                    if (r, at) != (k, s) and (ids[r] < ids[k] or hashes[r] == hashes[k]):
                        if ids[r] < ids[k] or at < s:
                            gone_row.append(k)
                            gone.append(s << 32 | c)
                        continue
                    row.append(k)
                    value.append(v)
                    start.append(s)
                    segment.append(own)
            columns = [signed(np.array(value, np.uint64)), pa.array(start, pa.int32()), pa.array(segment, pa.binary())]
            yield _both(batch, np.array(row, np.int64), columns, *_packed(np.array(gone_row, np.int64), pa.array(gone, pa.int64())), names)

    return mapped(held.select("doc_id", "row_hash", "text", "anchors"), run, "doc_id long, row_hash long, anchor long, start int, segment binary, settled array<long>")


def _first_of(group: np.ndarray, doc: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Of rows ordered by group, document and place: those that stay, the first of each group and of other rows of its doc_id."""
    new = np.concatenate([[True], group[1:] != group[:-1]])[: len(group)]
    other = new | np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
    low = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(doc) else doc
    return other & (doc == low)


def repeated_in(segments: list[bytes], anchors: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Which segment's windows also start earlier: indices of segments, and their runs of windows.

    Segments come ordered by anchor, document, row and start, and equal windows
    have equal anchors. Equal segments are one phrase of the indexed text. A
    place of it whose match is a window long has its source in the same class;
    classes are joined along sources, and all but their first places go.
    """
    kind, first = {}, np.empty(len(segments), np.int64)
    for i, s in enumerate(segments):
        first[i] = kind.setdefault(s, i)
    keep = np.array(sorted(kind.values()), np.int64)
    size = np.fromiter(map(len, segments), np.int64, len(segments))
    # Copies of a phrase, in order: whole runs go, but for rows of the first one's doc_id with another text.
    copies = np.flatnonzero(first != np.arange(len(segments)))
    group = np.argsort(np.concatenate([keep, first[copies]]), kind="stable")
    every = np.concatenate([keep, copies])[group]
    stays = np.zeros(len(segments), bool)
    stays[every[_first_of(first[every], doc[every], row[every])]] = True
    whole = np.flatnonzero(~stays)
    out, runs = [whole], [_runs(start[whole], size[whole] - window + 1)]
    index_of = np.flatnonzero(stays)
    # Other rows of a doc_id are texts of their own.
    text = np.frombuffer(b"".join(s + b"\xff" for s in (segments[i] for i in index_of)), np.uint8)
    begin = np.concatenate([[0], np.cumsum(size[index_of] + 1)])
    if len(text) <= window:
        return np.concatenate(out), np.concatenate(runs)
    per = size[index_of] - window + 1
    seg = np.repeat(np.arange(len(index_of)), per)
    place = np.arange(len(seg)) - np.repeat(np.cumsum(per) - per, per) + begin[seg]
    length, source = RunIndex(text).statistics(place)
    linked = np.flatnonzero(length >= window)
    if len(linked):
        number = np.empty(len(text), np.int64)
        number[place] = np.arange(len(place))
        parent = np.arange(len(place))
        parent[linked] = number[source[linked]]
        while True:
            further = parent[parent]
            if (further == parent).all():
                break
            parent = further
        member = np.zeros(len(place), bool)
        member[linked] = member[parent[linked]] = True
        at = np.flatnonzero(member)
        at = at[np.argsort(parent[at], kind="stable")]
        of = index_of[seg[at]]
        gone = np.sort(at[~_first_of(parent[at], doc[of], row[of])])
        new = np.concatenate([[True], (gone[1:] != gone[:-1] + 1) | (seg[gone[1:]] != seg[gone[:-1]])])[: len(gone)]
        head = np.flatnonzero(new)
        of = seg[gone[head]]
        out.append(index_of[of])
        runs.append(_runs(start[index_of[of]] + place[gone[head]] - begin[of], np.diff(head, append=len(gone))))
    return np.concatenate(out), np.concatenate(runs)


def repeated_windows(segments: DataFrame, window: int, block: int = BLOCK) -> DataFrame:
    """doc_id, row_hash, runs: the windows that also start earlier, as runs of starts."""
    names = ["doc_id", "row_hash", "runs"]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def judge(table: pa.Table):
            doc, row, anchor, start = (table.column(k).to_numpy() for k in range(4))
            same = np.concatenate([[False], (doc[1:] == doc[:-1]) & (row[1:] == row[:-1]) & (anchor[1:] == anchor[:-1]) & (start[1:] == start[:-1])])[: len(doc)]
            own = np.flatnonzero(~same)
            segment = table.column(4).take(pa.array(own)).to_pylist()
            at, runs = repeated_in(segment, anchor[own], doc[own], row[own], start[own], window)
            at = own[at]
            order = np.lexsort((row[at], doc[at]))
            at, runs = at[order], runs[order]
            new = np.flatnonzero(np.concatenate([[True], (doc[at][1:] != doc[at][:-1]) | (row[at][1:] != row[at][:-1])])[: len(at)])
            lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)).astype(np.int32)), pa.array(runs))
            return pa.RecordBatch.from_arrays([pa.array(doc[at[new]]), pa.array(row[at[new]]), lists], names)

        for batch in batches:
            settled = batch.column(5).is_valid()
            if settled.true_count:
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(settled) for k in (0, 1, 5)], names)
            own = batch.filter(pa.compute.invert(settled))
            if not own.num_rows:
                continue
            held.append(own.select([0, 1, 2, 3, 4]))
            if sum(b.nbytes for b in held) < block:
                continue
            table = pa.Table.from_batches(held)
            anchor = table.column(2).to_numpy()
            # All rows of the last anchor wait, as more may follow.
            done = int(np.searchsorted(anchor, anchor[-1]))
            at = 0
            while at < done:
                upto = int(np.searchsorted(np.cumsum(pa.compute.binary_length(table.column(4)).to_numpy()[at:done]), block)) + at
                upto = min(done, int(np.searchsorted(anchor, anchor[min(upto, done - 1)], "right")))
                yield judge(table.slice(at, upto - at))
                at = upto
            held = table.slice(done).to_batches()
        if held:
            yield judge(pa.Table.from_batches(held))

    dealt = segments.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "row_hash", "start")
    found = mapped(dealt, run, "doc_id long, row_hash long, runs array<long>")
    return found.groupBy("doc_id", "row_hash").agg(F.flatten(F.collect_list("runs")).alias("runs"))


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def dedup_bytes(docs: DataFrame, window: int = 100, anchor: int = ANCHOR, block: int = BLOCK) -> DataFrame:
    """Every document without the bytes of strings of ``window`` bytes that also start earlier.

    Earlier is in a smaller doc_id, or before in the same document. Strings are
    judged on the input's UTF-8, overlaps count, and none crosses documents.
    Returns ``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256``:
    ``n_spans`` are the maximal removed runs, ``kept`` the other bytes.

    The corpus is indexed in parts that no repeat crosses. A window goes by the
    least hash of the ``anchor``-byte strings in it, which equal windows share;
    runs of windows with the same one are a segment. Anchors are combined in
    each batch, then counted; documents without one that stands twice are done.
    The others deal their segments with such anchors out by anchor, one of a kind
    from each batch. The texts of some anchors at a time become one run-length
    Burrows-Wheeler index, in which equal segments are one phrase; matching
    statistics streamed from its sampled run ends give each place's match and
    source, and matches of a window or more are joined along sources to classes,
    of which the first place stays.

    An anchor's distinct segments are indexed by one task: copies add none, each
    changed copy some 170 bytes. Rows are sorted before batches are judged, so a
    task that runs again forms the same batches.

    Nulls: a null text is empty; a row with a null doc_id neither removes nor
    loses anything. Equal rows of a doc_id are one document; rows of a doc_id
    with other texts are documents that don't remove from one another. Texts
    shorter than a window lose nothing. No rows give no rows; other columns are
    ignored.
    """
    if not 0 < anchor <= window:
        raise ValueError("an anchor must fit into a window")
    rows = _rows(docs)
    found = cut(shared_anchors(rows, window, anchor))
    bits, size = flags(found, "doc_id", "row_hash")
    near, far = _candidates(rows, docs.sparkSession.sparkContext.broadcast(bits), size)
    # As in substrings.py: the hashed side are the lists, so that texts stream by unsorted.
    held = near.join(found.hint("shuffle_hash"), ["doc_id", "row_hash"])
    gone = repeated_windows(_segment_rows(held.sortWithinPartitions("doc_id", "row_hash"), window, anchor), window, block)
    gone = gone.withColumnsRenamed({"doc_id": "gone_id", "row_hash": "gone_hash"})
    both = near.join(gone.hint("shuffle_hash"), (near.doc_id == gone.gone_id) & (near.row_hash == gone.gone_hash), "left").select("doc_id", "text", "runs")
    return _kept(both.unionByName(far.select("doc_id", "text", F.lit(None).cast("array<long>").alias("runs"))), window)


def _kept(both: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, offsets = texts(batch.column(1))
            size = np.diff(offsets)
            removed, spans, kept, digests = [], [], [], []
            for k in range(batch.num_rows):
                part, runs = data[offsets[k] : offsets[k + 1]], batch.column(2)[k]
                left, n, m = part.tobytes(), 0, 0
                if runs.is_valid:
                    x = runs.values.to_numpy(zero_copy_only=False)
                    mark = np.zeros(len(part) + 1, np.int32)
                    np.add.at(mark, x >> 32, 1)
                    np.add.at(mark, (x >> 32) + (x & 0xFFFFFFFF) + window - 1, -1)
                    gone = np.cumsum(mark)[:-1] > 0
                    n, m = int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].sum())
                    left = part[~gone].tobytes()
                removed.append(n)
                spans.append(m)
                kept.append(left)
                digests.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(digests, pa.string())],
                [f.split()[0] for f in _KEPT.split(", ")],
            )

    return mapped(both.select("doc_id", "text", "runs"), run, _KEPT)


def op12_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(read(spark, sf_dir, "documents")).drop("kept")


OP12_SQL = r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
starts AS (SELECT doc_id, x, unnest(generate_series(1, n - 99)) AS s FROM docs WHERE n >= 100),
hashed AS (SELECT doc_id, s, md5(substr(x, 2 * s - 1, 200)) AS h FROM starts),
gone AS (SELECT doc_id, s FROM hashed QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
marked AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS new FROM gone),
numbered AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM marked),
spans AS (SELECT doc_id, k, min(s) AS a, max(s) + 99 AS b FROM numbered GROUP BY doc_id, k),
holes AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS last FROM spans),
totals AS (SELECT doc_id, sum(b - a + 1) AS removed, count(*) AS spans, max(b) AS last FROM spans GROUP BY doc_id),
pieces AS (SELECT h.doc_id, string_agg(substr(x, 2 * last + 1, 2 * (a - 1 - last)), '' ORDER BY a) AS t FROM holes h JOIN docs USING (doc_id) GROUP BY h.doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(t.removed, 0)::BIGINT AS n_removed, coalesce(t.spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(p.t, '') || substr(d.x, 2 * coalesce(t.last, 0) + 1))) AS kept_sha256
FROM docs d LEFT JOIN totals t USING (doc_id) LEFT JOIN pieces p USING (doc_id)
"""
