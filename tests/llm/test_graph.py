from kinfold.llm.graph import roots


def test_chains_end_at_the_heaviest(spark):
    nodes = spark.createDataFrame([(i, w) for i, w in enumerate([9, 8, 7, 6, 5, 4, 3, 2, 1, 9])], "id long, weight long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)] + [(8, 9)], "a long, b long")
    got = {r["id"]: r["root"] for r in roots(nodes, edges).collect()}
    assert got[0] == got[7] == 0 and got[8] == got[9] == 9


def test_no_edges(spark):
    nodes = spark.createDataFrame([(1, 1)], "id long, weight long")
    assert [tuple(r) for r in roots(nodes, spark.createDataFrame([], "a long, b long")).collect()] == [(1, 1)]
