import pytest
from pyspark.sql import functions as F

from kinfold.llm import mixing as M

TARGETS = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 4), ("gone", 0.05, 3)]


@pytest.fixture(scope="module")
def data(spark):
    docs = [(i, f"alpha apple {i} word " * (1 + i % 5), "a", 9) for i in range(800)] + [(1000 + i, f"beta bread {i} " * (1 + i % 3), "b", 9) for i in range(300)]
    docs += [(2000 + i, f"gamma {i} goat", "c", 9) for i in range(150)] + [(3000, "alpha apple", None, 9), (3001, None, "a", 9), (3002, "", "b", 9), (3003, "elsewhere", "z", 9)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens int")
    return d, spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_shares_and_caps(data):
    docs, targets = data
    mixed = M.mix(docs, targets)
    rows = mixed.collect()
    caps = {s: m for s, _, m in TARGETS}
    assert all(1 <= r["copies"] <= caps[r["source"]] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    share = {r["source"]: r["share"] for r in M.shares(mixed, targets).collect()}
    for s, t in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(share[s] - t / 0.95) < 0.01
    assert share["gone"] == 0


def test_posteriors_sum_to_one_and_find_the_source(data):
    docs, _ = data
    p = M.posteriors(docs.select(F.col("source").alias("label"), "text"), docs.filter("doc_id >= 3000").select(F.col("doc_id").alias("doc"), "text"), ["a", "b", "c"])
    got = {r["doc"]: r["p"] for r in p.collect()}
    assert set(got) == {3000, 3001, 3002, 3003} and all(abs(sum(v) - 1) < 1e-9 for v in got.values())
    assert got[3000][0] > 0.9


def test_rates_of_soft_members_meet_the_targets(spark):
    atoms = spark.createDataFrame([(100.0, 3.0, [1.0, 0.0]), (50.0, 3.0, [0.5, 0.5]), (10.0, 3.0, [0.0, 1.0])], "tokens double, cap double, p array<double>")
    moves, moved = M.fit_rates(atoms, [60.0, 40.0], steps=200, tolerance=1e-9)
    r = M.with_rates(atoms, moves, 2).collect()
    rate = {x["tokens"]: x["rate"] for x in r}
    assert abs(100 * rate[100] + 25 * rate[50] - 60) < 0.5 and abs(25 * rate[50] + 10 * rate[10] - 40) < 0.5
    assert all(0 <= x <= 3 for x in rate.values()) and moved < 1e-9


def test_rates_follow_posteriors_within_a_source(spark):
    """Labels fix the totals of sources; inside one, texts that read like a domain in need are used more."""
    rows = [(10.0, 2.0, [1.0, 0.0, 0.9, 0.1])] * 50 + [(10.0, 2.0, [1.0, 0.0, 0.2, 0.8])] * 50 + [(10.0, 2.0, [0.0, 1.0, 0.1, 0.9])] * 20
    atoms = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, tokens double, cap double, p array<double>").repartition(3)
    moves, _ = M.fit_rates(atoms, [600.0, 300.0, 600.0, 300.0], last=2)
    rate = {r["doc_id"]: r["rate"] for r in M.with_rates(atoms, moves, 4).collect()}
    assert abs(sum(10 * rate[i] for i in range(100)) - 600) < 2 and abs(sum(10 * rate[i] for i in range(100, 120)) - 300) < 2
    assert rate[0] != rate[60]


def test_soft_use_of_unlabelled(data):
    docs, targets = data
    assert {r["doc_id"] for r in M.mix(docs, targets, unlabelled_repeats=1).filter("source IS NULL").collect()} <= {3000}


def test_empty(spark, data):
    docs, targets = data
    assert M.mix(docs.limit(0), targets).count() == 0
