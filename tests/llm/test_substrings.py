import hashlib

import numpy as np
import pytest

from loomspan.llm import substrings


def brute(rows, size):
    words = {i: (t or "").encode().split() for i, t in rows}
    first: dict = {}
    for i, w in words.items():
        for s in range(len(w) - size + 1):
            k = tuple(w[s : s + size])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in words.items():
        gone = {p for s in range(len(w) - size + 1) if first[tuple(w[s : s + size])] < i for p in range(s, s + size)}
        out[i] = (len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone))
    return out


@pytest.mark.parametrize(("size", "period", "cover"), [(50, 31, substrings.COVER), (12, 7, (1, 2, 4)), (7, 7, (1, 2, 4))])
def test_against_brute_force(docs, corpus, size, period, cover):
    want = brute(corpus, size)
    assert sum(x[1] for x in want.values()) > 0
    for r in substrings.dedup_substrings(docs, size, period, cover).collect():
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept).hexdigest())


def test_covers():
    assert substrings.is_difference_cover(31, substrings.COVER) and not substrings.is_difference_cover(31, (0, 1, 2))


def test_edges(spark, empty, odd):
    assert substrings.dedup_substrings(empty).collect() == [] and substrings.dedup_substrings(odd).count() == 6
    text = " ".join(f"t{i}" for i in range(60))
    rows = spark.createDataFrame([(None, text), (4, text), (4, text), (9, text + " end")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in substrings.dedup_substrings(rows).collect())
    assert got == [("4", 0), ("4", 0), ("9", 60), ("None", 0)]


def test_row_order_that_changes_with_each_evaluation(spark):
    """Rows reach the batches in a new random order whenever they are read, as out of a shuffle."""
    size = 60

    def dealt(frames):
        import pandas as pd

        rows = pd.concat(list(frames))
        yield rows.sample(frac=1, random_state=np.random.default_rng())

    rows = [(i, " ".join(f"t{i % 100}x{k}" for k in range(size))) for i in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).mapInPandas(dealt, "doc_id long, text string")
        got = {r.doc_id: r.n_removed for r in substrings.dedup_substrings(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: 0 if i < 100 else size for i in range(200)}
