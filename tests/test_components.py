from loomspan.operators.components import components


def test_components(spark):
    path = [(i, i + 1) for i in range(20, 60)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6), (6, 6), (9, 9), (None, 4), (2, 1), *path], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 9: 9} | {i: 20 for i in range(20, 61)}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
