import hashlib
import random

import numpy as np
import pytest

from loomspan.llm import runindex as r


def brute(rows, size):
    texts = {i: (t or "").encode() for i, t in rows}
    first: dict = {}
    out = {}
    for i in sorted(texts):
        t = texts[i]
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - size + 1):
            if first.setdefault(t[s : s + size], (i, s)) != (i, s):
                gone[s : s + size] = True
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
        out[i] = (len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for k, b in enumerate(t) if not gone[k])).hexdigest())
    return out


def result(df):
    return {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in df.collect()}


TEXTS = [b"", b"a", b"banana", b"a" * 70, b"mississippi" * 9, b"abracadabra\xffabracad\xffx", bytes(random.Random(1).choices(range(3), k=700)), ("überall" * 30).encode()]


@pytest.mark.parametrize("text", TEXTS)
def test_index(text):
    """The runs give the text back; statistics are the match with the neighbour in the order of suffixes, for every place."""
    index = r.RunIndex(np.frombuffer(text, np.uint8))
    assert index.text() == text and index.lengths.sum() == len(text) + 1 and (index.symbols[1:] != index.symbols[:-1]).all()
    order = sorted(range(len(text)), key=lambda i: text[i:])
    length, source = index.statistics(np.arange(len(text)))
    for before, at in zip([None, *order], order, strict=False):
        shared = 0
        while before is not None and max(at, before) + shared < len(text) and text[at + shared] == text[before + shared]:
            shared += 1
        assert length[at] == shared and (not shared or source[at] == before)


def test_runs_of_a_repetitive_text_are_few():
    rng = random.Random(2)
    base = bytes(rng.choices(b"abcdefgh", k=400))
    text = np.frombuffer(b"\xff".join([base] * 50), np.uint8)
    assert len(r.RunIndex(text).symbols) < len(text) / 20


@pytest.mark.parametrize(("size", "anchor", "block", "batch"), [(100, 32, 1 << 20, 10_000), (100, 32, 20_000, 30), (30, 8, 5000, 10_000)])
def test_against_brute_force(spark, docs, corpus, size, anchor, block, batch):
    want = brute(corpus, size)
    assert sum(x[1] for x in want.values()) > 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert result(r.dedup_bytes(docs, size, anchor, block)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeats_within_a_document(spark):
    """Periodic and overlapping repeats, shifted ones, many-byte characters cut through, and copies with changes."""
    rng = random.Random(5)
    line = "".join(rng.choices("abcdefghij ", k=130))
    near = [line + line[:k] + "".join(rng.choices("xyz", k=40)) + line[k:] for k in (0, 30, 99, 100, 101, 120)]
    rows = ["a" * 99, "a" * 100, "a" * 101, "a" * 700, "ab" * 300, line * 3, line + "é" * 120 + line, "è" * 120, "\x00" * 150, "", None, *near, "é" + line[1:], line[:99], "ab" * 50 + "c"]
    rows = [(i * 3, t) for i, t in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(r.dedup_bytes(docs)) == brute(rows, 100)


def test_edges(spark, empty, odd):
    assert r.dedup_bytes(empty).collect() == [] and r.dedup_bytes(odd).count() == 6
    rng = random.Random(9)
    text, other = ("".join(rng.choices("abcdefgh", k=150)) for _ in range(2))
    rows = [(None, text), (None, text), (4, text), (4, text), (4, other + text), (9, text + other), (9, text + other), (2, "z" * 40)]
    got = sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in r.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    assert got == sorted(
        [("None", 150, 0, 0, text.encode())] * 2 + [("4", 150, 0, 0, text.encode())] * 2 + [("4", 300, 0, 0, (other + text).encode())] + [("9", 300, 300, 1, b"")] * 2 + [("2", 40, 0, 0, b"z" * 40)]
    )
    with pytest.raises(ValueError):
        r.dedup_bytes(empty, 10, 20)
