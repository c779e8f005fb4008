import hashlib
import time

from pyspark.sql import functions as F

from loomspan.llm import lines


def brute(rows, least=40, docs=5):
    keyed = {i: [(x, x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})) for x in (t or "").split("\n")] for i, t in rows}
    holders: dict = {}
    for i, own in keyed.items():
        for _, k in own:
            holders.setdefault(k, set()).add(i)
    hot = {k: max(v) for k, v in holders.items() if len(k) >= least and len(v) >= docs}
    return {i: [x for x, k in own if hot.get(k, i) == i] for i, own in keyed.items()}


def test_against_brute_force(docs, corpus):
    want = brute(corpus)
    for r in lines.dedup_lines(docs).collect():
        assert r.kept == want[r.doc_id] and r.dropped == len(r.lines) - len(r.kept)


def test_query_columns(spark, tmp_path, docs, corpus):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(corpus)
    got = lines.op3_line_dedup(spark, str(tmp_path)).collect()
    assert len(got) == len(corpus)
    for r in got:
        assert r.kept_sha256 == hashlib.sha256("\n".join(want[r.doc_id]).encode()).hexdigest()


def test_runs(spark):
    for at, runs in (([0, 1, 4], [(0, 2), (4, 1)]), ([2], [(2, 1)]), ([0, 0], [(0, 1)]), ([3, 1, 2], [(1, 3)]), ([5, 0], [(0, 1), (5, 1)]), (list(range(6)), [(0, 6)])):
        got = lines.runs_of(spark.createDataFrame([(1, p) for p in at], "k long, pos int"), "k").withColumn("x", F.lit(list("abcdef")))
        row = lines.apply_runs(got, "x", "runs", "kept").first()
        assert [tuple(r) for r in row.runs] == runs and row.dropped == len(set(at)) and row.kept == [c for i, c in enumerate("abcdef") if i not in at]
    none = spark.createDataFrame([(list("ab"), None)], "x array<string>, runs array<struct<start:int,size:int>>")
    assert lines.apply_runs(none, "x", "runs", "kept").first().kept == ["a", "b"]


def test_very_long_text(spark):
    """Time follows the lines: 60,000 of them, every other one dropped."""
    common = "a line that is common to all of the documents"
    long = "\n".join(common if i % 2 else f"own line {i}" for i in range(60_000))
    rows = [(i, long if i == 0 else common) for i in range(6)]
    began = time.time()
    kept = {r.doc_id: r.kept for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept[0] == [f"own line {i}" for i in range(0, 60_000, 2)] and kept[5] == [common] and kept[3] == []
    assert time.time() - began < 30


def test_edges(spark, empty, odd):
    assert lines.dedup_lines(empty).collect() == []
    assert lines.dedup_lines(odd).count() == 6
    long = "a line of at least forty characters, which repeats"
    rows = [(None, long), (None, long), *[(i, long) for i in (1, 2, 3)], (3, long + "\nmore")]
    kept = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=4).collect()
    assert sorted((str(r.doc_id), r.dropped) for r in kept) == [("1", 1), ("2", 1), ("3", 0), ("3", 0), ("None", 1), ("None", 1)]
