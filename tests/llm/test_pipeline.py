import hashlib

import corpus_pipeline
from loomspan.llm import decontaminate
from tests_llm_helpers import brute_components, brute_contaminated, brute_lines, library


def test_stages_against_brute_force(spark):
    """Each stage on its own input, and the whole."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    for (name, stage), k in zip(corpus_pipeline.STAGES, range(5), strict=True):
        out = stage(spark, docs, sf)
        rows = out.collect()
        texts = {i: r.text for i, r in before.items()}
        if k < 4:
            assert set(out.columns) == set(corpus_pipeline.COLUMNS), name
        if k == 0:
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            kept = {r.doc_id for r in rows}
            right = [(i in kept) == bool(q) for i, q in labels.items() if i in texts]
            assert sum(right) / len(right) > 0.9 and all(r.text == texts[r.doc_id] for r in rows)
        if k == 1:
            assert {r.doc_id: r.text for r in rows} == {i: "\n".join(x) if x is not None else texts[i] for i, x in brute_lines(texts).items()}
        if k == 2:
            assert {r.doc_id for r in rows} == {i for i, c in brute_components(texts, 5, 80).items() if i == c}
        if k == 3:
            assert {r.doc_id for r in rows} == set(texts) - brute_contaminated(texts, bench)
        if k == 4:
            enc = library()
            want = {i: hashlib.sha256(" ".join(map(str, enc.encode_ordinary(t or ""))).encode()).hexdigest() for i, t in texts.items()}
            assert {r.doc_id: r.ids_sha256 for r in rows} == want
            whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
            assert whole == want
            break
        docs = spark.createDataFrame(rows, out.schema)
        before = {r.doc_id: r for r in rows}
    assert decontaminate.WINDOW == 13


def test_odd_rows_and_empty_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, several texts of one id and no rows pass every stage."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    words = " ".join(f"word{i}" for i in range(40))
    item = "the quick brown fox jumps over the lazy dog near the old river bank today"
    rows = [(None, words), (None, None), (1, None), (2, ""), (3, words), (3, words), (3, "another text of this id, quite unlike the first"), (4, words), (4, f"so {item} ends"), (4, "clean text of the same id that has nothing of it")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], kinds)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for one in (docs, docs.limit(0)):
        one.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        out = {}
        for name, stage in corpus_pipeline.STAGES:
            out[name] = [tuple(r) for r in stage(spark, one, str(tmp_path)).collect()]
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == (0 if not out["quality classifier"] else 8)
        if out["quality classifier"]:
            texts = lambda name: sorted((str(r[0]), str(r[1])) for r in out[name])
            every = sorted((str(i), str(t)) for i, t in rows)
            assert texts("quality classifier") == texts("line dedup") == every
            assert texts("near-dedup") == sorted(r for r in every if r != ("4", words))
            assert texts("benchmark decontamination") == sorted(r for r in every if "quick brown" not in r[1])
            assert len(out["byte-level BPE"]) == len(rows)
