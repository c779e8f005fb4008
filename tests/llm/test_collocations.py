import random
import re
from collections import Counter

import numpy as np
import pytest

from loomspan.llm import collocations as c


def brute(rows, least, longest=5, percent=100, top=2000):
    """Every phrase counted, every cut scored."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({k: k + 32 for k in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    kept = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in kept.items():
        inside = any(g == lang and len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in kept.items())
        if not inside:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))  # noqa: E741
            out.append((lang, " ".join(p), a, l, r, n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    place = Counter()
    ranked = []
    for x in out:
        place[x[0]] += 1
        if place[x[0]] <= top:
            ranked.append((x[0], place[x[0]], *x[1:]))
    return ranked


def result(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    set_ = ["new york city", "a b c d e f", "über die brücke", "to be or not to be"]
    rows = []
    for i in range(300):
        words = []
        while len(words) < rng.randrange(1, 60):
            words += [rng.choice(set_)] if rng.random() < 0.3 else [f"w{min(rng.randrange(40), rng.randrange(40))}"]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for w in words)
        rows.append((["en", "de", None, "en"][i % 4], text.title() if i % 5 == 0 else text))
    return [*rows, ("en", None), (None, ""), ("en", "x x x x x x x x x"), ("en", "x x x x x x x x x"), ("de", " . , \n"), ("fr", "only few words"), ("en", "L" * 70_000 + " tail")]


@pytest.mark.parametrize(("least", "percent", "buckets"), [(4, 100, None), (6, 60, 13), (3, 100, 20), (300, 100, None)])
def test_against_brute_force(spark, texts, least, percent, buckets):
    # Columns of the operator's own names, more than one task, and batches of a few rows.
    docs = spark.createDataFrame([(i, a, t, 1, "x") for i, (a, t) in enumerate(texts)], "doc_id long, lang string, text string, n int, phrase string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = result(c.collocations(docs, least, percent=percent, buckets=buckets))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute(texts, least, percent=percent)
    assert got == sorted(want) and (least > 6 or {len(x[2].split()) for x in want} >= {2, 3, 4, 5})


def test_first_rows_of_each_lang(spark, texts):
    docs = spark.createDataFrame(texts, "lang string, text string")
    assert result(c.collocations(docs, 4, longest=3, top=5)) == sorted(brute(texts, 4, 3, top=5))


def test_products_beyond_64_bits(spark):
    """1000 * a * n passes 2**63 in the arithmetic of the scores."""
    from pyspark.sql import functions as F

    a, n = 9_000_000_000_000, 9_000_000_000_000_000
    exact = lambda x: F.lit(x).cast("decimal(19,0)")
    over = spark.range(1).withColumns({"_over": F.lit(1000).cast("decimal(4,0)") * exact(a) * exact(n), "_under": exact(a + 7) * exact(a + 1)})
    assert over.select(F.expr("_over div _under").alias("s")).first().s == 1000 * a * n // ((a + 7) * (a + 1))


def test_bucket_counts_add_up_over_rows_of_a_segment(spark):
    hits = [np.array([5, 5, 9000, 9000, 9000, 3], np.uint32), np.array([5, 9000, 70_000], np.uint32)]
    rows = [r for h in hits for r in c._segments([h], 3).to_pylist()]
    passed = spark.createDataFrame([(r["segment"], bytearray(r["counts"])) for r in rows], "segment int, counts binary")
    bits = np.unpackbits(c._hot_buckets(passed, 3, 17), bitorder="little")
    assert np.flatnonzero(bits).tolist() == [5, 9000]


def test_no_rows_and_no_words(spark, empty):
    assert c.collocations(empty).collect() == []
    blank = spark.createDataFrame([("en", None), (None, " .. \t")], "lang string, text string")
    assert c.collocations(blank, 1).collect() == []
