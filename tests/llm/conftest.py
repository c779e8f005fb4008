import random

import pytest


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, common lines, nulls, empties and one long text."""
    rng = random.Random(7)
    rows, base = [], [" ".join(words(rng, rng.randrange(5, 180))) for _ in range(30)]
    passage = words(rng, 70)
    line = "This line stands in many of the documents, in whatever case."
    for i in range(90):
        text = base[i % 30]
        if i % 3 == 1:
            w = text.split()
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        if i % 5 == 0:
            text = text + "\n  " + (line.upper() if i % 2 else line) + "\t\n" + line
        if i % 7 == 0:
            text = " ".join(words(rng, 9)) + " " + " ".join(passage[i % 4 :]) + " " + text
        rows.append((i, text))
    rows += [(90, None), (91, ""), (92, " \n\t"), (93, "one"), (94, "one two"), (95, "é" * 300 + " ü"), (96, " ".join(words(rng, 6000))), (97, "\n\n")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    # Extra columns of the operators' own names.
    return spark.createDataFrame([(i, t, "x", "s", 1.0, 2) for i, t in corpus], "doc_id long, text string, lang string, source string, anchor double, start int").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated ids and repeated rows."""
    return spark.createDataFrame([(None, "a b c d"), (None, None), (5, "x y z w v"), (5, "x y z w v"), (5, "other text entirely"), (6, None)], "doc_id long, text string")
