import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import quality


@pytest.fixture(scope="module")
def scored(spark):
    return quality.op5_bradley_terry(spark, "/root/testdata/sf0.01").toPandas()


def test_held_out_accuracy(spark, scored):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = scored.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert (held.quality == held.predicted).mean() > 0.95
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.3)).all()
    assert all(scored.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id])


def test_held_out_labels_are_not_used(spark, scored):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.remainder(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.learn(docs, turned).weights == quality.learn(docs, labels).weights).all()


def test_pairwise_loss_orders():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 1] + 0.1 * rng.normal(size=400) > -0.8).astype(int)
    model = quality.bradley_terry(x, y)
    assert np.mean((model.score(x) >= 0.3) == y) > 0.9


def test_weights_against_all_pairs():
    """Full-batch descent over every preference pair gives the same order of scores."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3)) * [1.0, 5.0, 0.2] + [0, 2, 1]
    y = (x @ [1.0, -0.3, 4.0] + rng.normal(size=60) > 3.0).astype(int)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    diff = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 3)
    w = np.zeros(3)
    for _ in range(4000):
        w += 0.1 * ((diff / (1 + np.exp(diff @ w))[:, None]).mean(0) - 1e-3 * w)
    model = quality.bradley_terry(x, y, steps=1500)
    assert np.abs(model.weights - w).max() < 0.15 * np.abs(w).max()
    assert np.mean(model.raw(x) < model.threshold) == np.mean(y == 0) or abs(np.mean(model.raw(x) < model.threshold) - np.mean(y == 0)) < 0.02


def test_repeated_ids_give_one_row(spark):
    rows = [(i % 7, f"Some words number {i}. And more of them, here!" * (1 + i % 3)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] + [(1, 0)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first, second = quality.learn(docs, labels), quality.learn(docs.repartition(5), labels)
    assert (first.weights == second.weights).all() and first.threshold == second.threshold


def test_edges(spark, empty, odd):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.learn(odd, labels)
    assert [r.quality_score for r in quality.score_documents(odd.withColumn("quality_score", F.lit("x")), model).collect()] == [0.5] * 6
    assert quality.score_documents(empty, model).collect() == []
