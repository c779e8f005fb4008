"""Vector indexes by cells and packed codes."""

import numpy as np
import pytest

from loomspan.operators import retrieval
from loomspan.sources.vectors import VectorIndex, lookup, pack

KIND = "id long, embedding array<float>, note string"


def rows(n=600, size=12, centres=15, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(centres, size))
    x = base[rng.integers(0, centres, n)] + 0.35 * rng.normal(size=(n, size))
    x[5] = x[6] = x[7]  # ties
    x[8] = 0
    return [(i, [float(np.float32(v)) for v in r], "n") for i, r in enumerate(x)]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    index = VectorIndex(spark, str(tmp_path_factory.mktemp("vectors")))
    data = spark.createDataFrame([*rows(), (None, [1.0] * 12, "x"), (9999, None, "y")], KIND)
    assert index.build(data.repartition(3), cells=16) == 1
    queries = spark.createDataFrame([(i, v) for i, v, _ in rows(40, seed=2)] + [(None, [0.5] * 12), (77, None)], "query_id long, embedding array<float>")
    return index, data, queries


def ranked(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((-round(r.similarity, 6), r.id))
    return {q: sorted(x) for q, x in out.items()}


def test_exact_search_is_a_scan(built):
    index, data, queries = built
    want = ranked(retrieval.batch_nearest(data, queries, 10))
    assert ranked(index.search(queries, 10, probes=1, exact=True)) == want == ranked(index.search(queries, 10, probes=99))
    assert ranked(index.search(queries, 700, probes=2, exact=True)) == ranked(retrieval.batch_nearest(data, queries, 700))


def test_recall_of_probes(built):
    index, data, queries = built
    want, got = ranked(retrieval.batch_nearest(data, queries, 10)), ranked(index.search(queries, 10, probes=5))
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)


def test_only_probed_cells_are_read(built, spark):
    index, _, queries = built
    asked = index._asked(queries.where("query_id = 3"), "query_id", 2)
    held = index._probed(asked)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan, codes = (df._jdf.queryExecution().executedPlan().toString() for df in (held, held.select("id", "codes")))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    cells = {r["cell"] for r in asked.collect()}
    assert len(cells) == 2 and {r["cell"] for r in held.select("cell").distinct().collect()} == cells
    assert "PartitionFilters: [cell#" in plan and "ReadSchema: struct<id:bigint,codes:binary>" in codes


@pytest.mark.parametrize("bits", [2, 3, 4])
def test_codes(spark, tmp_path, bits):
    rng = np.random.default_rng(bits)
    codes = rng.integers(0, 1 << bits, (5, 7)).astype(np.uint8)
    q = rng.normal(size=7)
    table, packed = lookup(q, bits), pack(codes, bits)
    top = (1 << bits) - 1
    assert np.allclose(table[np.arange(packed.shape[1])[None, :], packed].sum(axis=1), (codes / (top / 2) - 1) @ q)
    index = VectorIndex(spark, str(tmp_path))
    data = spark.createDataFrame([(i, [v / 4 for v in x], n) for i, x, n in rows(120)], KIND)
    index.build(data, bits=bits)
    one = data.where("id = 3").first()["embedding"]
    want = [(r.id, round(r.similarity, 6)) for r in retrieval.nearest_quantised(data, list(one), 9, bits).collect()]
    asked = spark.createDataFrame([(1, list(one))], "query_id long, embedding array<float>")
    got = sorted(((r.id, round(r.similarity, 6)) for r in index.search_codes(asked, 9, quantised_query=True).collect()), key=lambda x: (-x[1], x[0]))
    assert got == want
    plain = {r.id for r in index.search_codes(asked, 9).collect()}
    assert 3 in plain and len(plain) == 9


def test_versions_and_empty(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path))
    none = spark.createDataFrame([], KIND)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert index.build(none) == 1 and index.search(queries, 3).collect() == [] and index.search(queries, 3, exact=True).collect() == []
    assert index.build(spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b")], KIND)) == 2
    assert [r.id for r in index.search(queries, 1).collect()] == [1]
    # A version whose last file is missing is not seen.
    spark.createDataFrame([(5, 0)], "id long, cell int").write.parquet(f"{tmp_path}/v3/rows")
    assert [r.id for r in index.search(queries, 1).collect()] == [1]
