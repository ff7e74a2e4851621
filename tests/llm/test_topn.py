import math
import random

from kinfold.llm import topn
from kinfold.llm.topn import top_n


def brute(rows, n):
    best = {}
    for g, i, s in rows:
        if i is not None and s is not None and not math.isnan(s):
            best[g, i] = max(s, best.get((g, i), -math.inf))
    groups = {}
    for (g, i), s in best.items():
        groups.setdefault(g, []).append((-s, i))
    return {(g, k + 1, i, -s) for g, v in groups.items() for k, (s, i) in enumerate(sorted(v)[:n])}


def test_against_brute_force(spark):
    rng = random.Random(2)
    scores = [0.0, 0.5, 0.5, 1.0, None, float("nan"), -1.0, float("inf")]
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), f"i{rng.randrange(60)}", rng.choice(scores)) for _ in range(3000)]
    rows += [("x", None, 1.0), ("y", "i1", None), ("z", "é", 1.0), ("z", "z", 1.0), ("z", "𝒳", 1.0), ("z", "～", 1.0)]
    df = spark.createDataFrame([(*r, "extra", 1.0) for r in rows], "s1 string, cand string, score double, h string, down double")
    got = {(r["s1"], r["rank"], r["cand"], r["score"]) for r in top_n(df, "s1", "cand", "score", 3).collect()}
    assert got == brute(rows, 3)


def test_zero_signs_are_equal_and_infinite_scores_rank(spark):
    df = spark.createDataFrame([("g", "b", 0.0), ("g", "a", -0.0), ("g", "c", float("-inf"))], "g string, i string, s double")
    assert [r["i"] for r in top_n(df, "g", "i", "s", 3).orderBy("rank").collect()] == ["a", "b", "c"]


def test_empty(spark):
    assert top_n(spark.createDataFrame([], "g string, i string, s double"), "g", "i", "s", 5).count() == 0


def test_heaps_are_bounded_before_the_shuffle(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice("aaab"), f"i{rng.randrange(500)}", float(rng.randrange(50))) for _ in range(20000)]
    df = spark.createDataFrame(rows, "g string, i string, s double").repartition(3)
    kept = topn.heaps(df, 5)
    assert kept.count() <= 3 * 2 * 5
    monkeypatch.setattr(topn, "AT_ONCE", 700)  # many merges, and heaps handed on in between
    monkeypatch.setattr(topn, "MOST", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
    try:
        assert {(r["g"], r["rank"], r["i"], r["s"]) for r in top_n(df, "g", "i", "s", 5).collect()} == brute(rows, 5)
        assert df.count() > topn.heaps(df, 5).count() > 30
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = top_n(df, "g", "i", "s", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
