"""Top-k search by levels of postings, against the ranking of all matches."""

import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import retrieval
from loomspan.sources.postings import PostingIndex

SCHEMA = "id long, title string, summary string, content string, rank string"


def made(n=400, seed=3):
    rng = random.Random(seed)
    words = ["shuffle", "spill", "broadcast", "parquet", "lantern", "orchard"]
    rows = []
    for i in range(n):
        often = 1 + int(rng.paretovariate(0.9)) if rng.random() < 0.5 else 1
        text = [w for w in words if rng.random() < 0.7 for _ in range(min(often, 200))]
        rng.shuffle(text)
        rows.append((i, rng.choice([None, "", "shuffle plan", "spill"]), None, " ".join(text), "own"))
    return rows


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    docs = spark.createDataFrame([*made(), (None, "shuffle", None, "shuffle " * 300, None)], SCHEMA)
    index = PostingIndex(spark, str(tmp_path_factory.mktemp("postings")))
    index.build(docs)
    return docs.where("id is not null"), index


@pytest.mark.parametrize("query", ["shuffle", "shuffle spill", '"shuffle spill" orchard', "shuffle -lantern", "broadcast or orchard", 'parquet -"spill shuffle"', "shuffle spill broadcast parquet", "shuffle absent"])
def test_top_is_the_ranking_of_all(indexed, query):
    docs, index = indexed
    every = sorted(((-r["rank"], r["id"]) for r in retrieval.match(docs, query).collect()))
    for k in (3, 1000):
        got = [(-r["rank"], r["id"]) for r in index.top(query, k).rows.collect()]
        assert sorted(got) == every[:k]


def test_levels_below_are_not_read(spark, indexed, tmp_path):
    docs, index = indexed
    top = index.top("shuffle", 3)
    assert top.blocks_read < top.blocks and top.postings_read < top.postings / 2
    one = PostingIndex(spark, str(tmp_path), fields={"content": 0.2})
    one.build(docs)
    top = one.top("shuffle spill", 3)
    assert top.blocks_read < top.blocks and top.postings_read < top.postings / 2
    assert [r["id"] for r in top.rows.collect()] == [r["id"] for r in retrieval.match(docs, "shuffle spill", fields={"content": 0.2}).orderBy(F.desc("rank"), "id").limit(3).collect()]
    plan = one.postings({"shuffl"}, 3)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1] and "level" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_edges(spark, tmp_path):
    empty = PostingIndex(spark, str(tmp_path / "empty"))
    empty.build(spark.createDataFrame([], SCHEMA))
    assert empty.top("shuffle", 5).rows.collect() == []
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "", "the and", None), (3, None, None, "long " * 50_000 + "needle", None)], SCHEMA)
    index = PostingIndex(spark, str(tmp_path / "some"))
    index.build(docs)
    assert [r["id"] for r in index.top("needle", 5).rows.collect()] == [3]
    assert index.top("the", 5).rows.collect() == [] and index.top("-needle", 5).rows.collect() == [] and index.top("needle", 0).rows.collect() == []
    with pytest.raises(ValueError):
        index.build(docs.union(docs))
