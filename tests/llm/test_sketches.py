import re

import numpy as np
import pytest

from loomspan.llm import sketches


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(docs, corpus, size, percent):
    want = brute(corpus, size, percent)
    assert sum(not k for _, _, k in want.values()) > 20
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in sketches.near_duplicate_groups(docs, size, percent).collect()}
    assert got == want


def test_large_bucket_by_prefixes(spark, monkeypatch):
    """A bucket beyond one task finds chains that no pivot links."""
    monkeypatch.setattr(sketches, "BLOCK", 4)
    words = [f"v{i}" for i in range(100)]
    rows = [(k, " ".join(words[:k] + [f"u{i}" for i in range(k)] + words[2 * k :])) for k in range(0, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in sketches.near_duplicate_groups(docs, 1, 85).collect()}
    assert got == {i: c for i, (_, c, _) in brute(rows, 1, 85).items()}


def test_links_of_a_large_bucket(spark, monkeypatch):
    """All that joins components of one bucket, as in one task: half a template, near copies and others."""
    rng = np.random.default_rng(5)
    template, sets = rng.integers(1, 2**63, 60), []
    for g in range(25):
        base = np.concatenate([template, rng.integers(1, 2**63, 60)])
        sets += [np.unique(np.concatenate([base[rng.random(120) > 0.06], rng.integers(1, 2**63, rng.integers(0, 8))])) for _ in range(rng.integers(1, 4))]
    rows = [(1, i, len(sets), 10**9, i, bytearray(x.astype(np.uint64).tobytes())) for i, x in enumerate(sets)]
    rest = spark.createDataFrame(rows, "bucket long, rep long, members long, volume long, component long, shingles binary").repartition(3)
    sets_ = rest.select("rep", "shingles")
    rest = rest.drop("shingles")
    linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert {(r.a, r.b) for r in sketches._across(rest, sets_, 85).collect()} == linked and len(linked) > 5
    label = [i // 2 for i in range(len(sets))]
    halves = rest.withColumn("component", (rest.component / 2).cast("long"))
    got = {(label[r.a], label[r.b]) for r in sketches._across(halves, sets_, 85).collect()}
    assert got == {(label[i], label[j]) for i, j in linked if label[i] != label[j]}


def test_sketch():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**32, 3000, dtype=np.uint32)

    def registers(x):
        return sketches.registers_of(np.stack([(x * a + b).min() for a, b in zip(sketches._A, sketches._B, strict=True)]))

    a, b = pool[:2000], pool[500:2500]
    assert (sketches.merge(registers(a), registers(b)) == registers(np.concatenate([a, b]))).all()
    est = sketches.likeliest(registers(a)[None], registers(b)[None], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(est - 0.6) < 0.2


def test_edges(empty, odd):
    assert sketches.near_duplicate_groups(empty).collect() == []
    got = sketches.near_duplicate_groups(odd).collect()
    assert len(got) == 6 and all(r.component_id is None and not r.kept for r in got if r.doc_id is None)
    assert all(r.kept for r in got if r.doc_id is not None)


def test_texts_of_one_id(spark):
    """Each text of a repeated doc_id is linked by itself, and repeated rows are one set."""
    words = [f"w{i}" for i in range(60)]
    a, b, other = " ".join(words), " ".join(words[:59] + ["x"]), " ".join(f"q{i}" for i in range(30))
    near = " ".join(f"q{i}" for i in range(29)) + " z"
    rows = [(5, a), (5, other), (5, other), (2, b), (9, near), (9, near), (7, "alone in here we are")]
    got = sketches.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got)
    assert found == [(2, 58, 2, True), (5, 28, 5, True), (5, 28, 5, True), (5, 58, 2, False), (7, 3, 7, True), (9, 28, 5, False), (9, 28, 5, False)]
