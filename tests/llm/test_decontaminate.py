import random

from pyspark.sql import functions as F

from loomspan.llm import decontaminate as d


def test_masks():
    assert all(d.masks_cover(n) for n in range(d.SHORTEST, d.WINDOW + 1))


def test_against_brute_force(spark):
    import re

    rng = random.Random(3)
    vocabulary = [f"tok{i}" for i in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, text(rng.randrange(5, 40))) for k in range(12)] + [(50, text(8)), (51, text(9)), (52, text(10)), (53, text(4)), (54, text(5)), (55, text(6)), (56, text(7))]
    docs = []
    for i in range(120):
        w = text(rng.randrange(0, 60))
        if i % 2:
            piece = list(rng.choice(items)[1])
            for _ in range(rng.randrange(0, 1 + len(piece) // 4)):
                piece[rng.randrange(len(piece))] = "other"
            cut = rng.randrange(0, 4)
            w[5:5] = piece[cut:]
        docs.append((i, ", ".join(w).title() if i % 3 else " ".join(w)))
    docs += [(200, None), (201, ""), (None, " ".join(items[0][1]))]
    norm = lambda t: re.findall(r"[0-9a-z]+", (t or "").lower())
    want = set()
    for i, t in docs:
        w = norm(t)
        for k, y in items:
            n = min(d.WINDOW, len(y))
            if len(y) >= d.EXACT and i is not None:
                for a in range(len(w) - n + 1):
                    for b in range(len(y) - n + 1):
                        if sum(w[a + j] == y[b + j] for j in range(n)) >= n - d.allowed(n):
                            want.add((i, k))
    got = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(None, "x"), (99, None)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 20


def test_edges(spark, empty, odd):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(odd, bench).collect() == []
    assert d.contaminated(empty, spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")).collect() == []


def test_scripts_without_blanks_and_texts_of_one_id(spark):
    """Characters of Chinese are words; of a repeated doc_id each text is tested by itself."""
    item = "今天天气很好我们去公园散步吧然后回家吃饭"
    docs = [(1, "前言" + item + "结尾"), (1, "clean text with other words in it entirely"), (2, "今天天气不错"), (3, "alpha beta gamma delta epsilon"), (3, "alpha beta other gamma delta epsilon")]
    bench = spark.createDataFrame([(9, item), (8, "alpha beta gamma delta epsilon")], "item_id long, text string")
    got = d.contaminated_rows(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    rows = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("h"), "text").collect()
    hashes = {r.text: r.h for r in rows}
    assert sorted((r.doc_id, r.row_hash, r.item_id) for r in got) == sorted([(1, hashes[docs[0][1]], 9), (3, hashes[docs[3][1]], 8)])


def test_repetitive_text(spark):
    """A text of one phrase over and over has many diagonals; they are verified in one row."""
    item = " ".join(["row", "your", "boat"] * 12)
    docs = spark.createDataFrame([(1, " ".join(["row", "your", "boat"] * 3000)), (2, "row your boat once")], "doc_id long, text string")
    got = d.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.matched_words) for r in got] == [(1, 1, 13)]
