import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from loomspan.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels, letters="ABCDE"):
    """Every order carried out on the documents, one filter after the other."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    rows = []
    for i, t, source in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A"} if len(w) < 50 else set()
        fails |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and any((u or "") == t and j is not None and j < i for j, u, _ in docs) else set()
        rows.append((source or "", fails, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        worth = dict.fromkeys(letters, 0)
        for order in permutations(letters):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(r[0] == part and f in r[1] for r in rows)
                alone = sum(r[0] == part and r[1] == {f} for r in rows)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                worth[f] += len(gone)
        for (p, order, step), x in out.items():
            if p == part:
                x.append(worth[order[step - 1]])
    return out


def result(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_against_every_order(spark):
    plain = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", plain, "A " * 60, "b " * 60, plain + " $", plain.upper(), "short", "short # X", "\t\n ", plain, "b " * 60, "é" * 70, plain + "\x0bQ" * 3, "short"]
    docs = [(i, t, ["s", None, "", "big", "big"][i % 5]) for i, t in enumerate(texts)] + [(20 + k, texts[k % 15], "big") for k in range(40)] + [(None, "short", "s"), (None, "short", "s"), (2, plain, "s"), (2, "two", "s")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 50, 2)] + [(4, 1, 0), (4, 1, 1), (None, 1, 1), (6, None, None)]
    d = spark.createDataFrame([(i, t, s, 1, 2, "x") for i, t, s in docs], "doc_id long, text string, source string, mask int, part int, digest string").repartition(4)
    found = audit.audit(audit.judged(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert dict(found.dtypes)["step"] == "int" and dict(found.dtypes)["shapley"] == "bigint"
    got = result(found)
    assert got == brute(docs, labels) and any(x[2] for x in got.values()) and any(x[3] for x in got.values()) and any(x[5] for x in got.values())


def test_rows_of_masks(spark):
    """Any filters: three of them, null parts and labels, a clashing column, and no rows."""
    masks = [(None, 3, 1, None), ("", 1, None, 1), ("p", 7, 1, 1), ("p", 0, 1, 0), ("p", 4, 0, 0), ("p", None, 0, 0)]
    got = result(audit.audit(spark.createDataFrame([(*m, 5) for m in masks], "part string, mask int, good int, toxic int, kept int"), "xyz"))
    assert len(got) == 2 * 6 * 3 and got["p", "xyz", 3] == [2, 1, 1, 1, 0, 0, 2 + 2 + 2 * 2] and got["", "yxz", 2][:3] == [0, 1, 1]
    assert audit.audit(spark.createDataFrame([], "part string, mask int, good int, toxic int")).collect() == []
    with pytest.raises(ValueError):
        audit.audit(spark.createDataFrame([], "part string, mask int, good int, toxic int"), "abcdefg")


def test_zeta_is_a_sum_over_subsets(spark):
    counts = [3, 1, 4, 1, 5, 9, 2, 6]
    got = spark.range(1).select(audit.zeta(F.array(*[F.lit(c).cast("long") for c in counts]), 3).alias("z")).first().z
    assert got == [sum(c for m, c in enumerate(counts) if m & s == m) for s in range(8)]


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(audit.judged(empty, labels)).collect() == []
