import itertools

import pytest
from pyspark.sql import functions as F

from kinfold.operators import blocking as B
from kinfold.operators import measure as M
from kinfold.operators import score as S
from kinfold.operators import truth as L


@pytest.fixture(scope="module")
def tables(spark, sf):
    return [B.keyed(spark.read.parquet(f"{sf}/train_s{n}.parquet")) for n in (1, 2, 3)]


def brute(a, b):
    rows_a, rows_b = a.collect(), b.collect()
    out = {}
    for x, y in itertools.product(rows_a, rows_b):
        if any(x[l] is not None and x[l] == y[r] for _, l, r, _ in B.RULES):
            flags = []
            for flag in B.FLAGS:
                v = []
                for _, l, r, f in B.RULES:
                    if f == flag:
                        v.append(False if x[l] is None else None if y[r] is None else x[l] == y[r])
                flags.append(True if True in v else None if None in v else False)
            out[x["entity_id"], y["entity_id"]] = tuple(flags)
    return out


def test_pairs_equal_the_disjunction_with_its_nulls(tables):
    got = {(r["s1_id"], r["cand_id"]): tuple(r[f] for f in B.FLAGS) for r in B.generate_pairs(tables[0], tables[1], "S2").collect()}
    assert got == brute(tables[0], tables[1])


def test_mask_flags_are_the_true_ones(tables):
    three = {(r["s1_id"], r["cand_id"]): tuple(bool(r[f]) for f in B.FLAGS) for r in B.generate_pairs(tables[0], tables[2], "S3").collect()}
    two = {(r["s1_id"], r["cand_id"]): tuple(r[f] for f in B.FLAGS) for r in B.generate_pairs(tables[0], tables[2], "S3", null_flags=False).collect()}
    assert two == three


def test_volume_equals_join_size(tables):
    for _, l, r, _ in B.RULES:
        want = tables[0].select(F.col(l).alias("k")).join(tables[1].select(F.col(r).alias("k")), "k").count()
        assert M.pair_volume(tables[0], tables[1], l, r).first()["pairs"] == want


def test_no_product_in_the_plan(tables):
    plan = B.generate_pairs(tables[0], tables[1], "S2")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_pack_keeps_every_entity(spark):
    s1 = spark.createDataFrame([("a",), ("b",), ("b",)], "entity_id string")
    pairs = spark.createDataFrame([("a", "y", "S2"), ("a", "x", "S3"), ("a", "x", "S3")], "s1_id string, cand_id string, cand_source string")
    assert {tuple(r) for r in B.pack(pairs, s1).collect()} == {("a", "x,y"), ("b", "")}


def test_links(spark):
    t = spark.createDataFrame([("a", "x, y,"), ("b", None), ("c", ""), ("a", "x")], "source1_entity_id string, matched_entity_ids string")
    assert sorted(map(tuple, L.parse_links(t).collect())) == [("a", "x"), ("a", "y")]


def test_distribution_and_buckets(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 3, 10, 50)], "n long")
    r = M.distribution(df, "n").first()
    assert (r["p50"], r["p90"], round(r["p99"], 9), r["largest"], r["total"]) == (3.0, 34.0, 48.4, 50, 66)
    assert [tuple(x) for x in M.buckets(df, "n").collect()] == [("1-10", 4), ("11-100", 1)]


def test_capped_recall_grows_with_the_cap(spark, sf):
    from kinfold.plans.catalog import QUERIES

    rows = [r for r in QUERIES["block_capped"](spark, sf).collect() if r["cap_kind"] == "symmetric"]
    hits = [r["hits"] for r in sorted(rows, key=lambda r: r["cap"])]
    assert hits == sorted(hits)


def test_macro_f05(spark):
    s1 = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "entity_id string")
    truth = spark.createDataFrame([("a", "x"), ("a", "y"), ("d", "q")], "s1_id string, cand_id string")
    pred = spark.createDataFrame([("a", "x"), ("c", "z"), ("d", "r")], "s1_id string, cand_id string")
    # a: P 1, R 0.5; b: both empty; c: a prediction without truth; d: no hit
    want = (1.25 * 0.5 / (0.25 + 0.5) + 1 + 0 + 0) / 4
    assert abs(S.macro_f05(pred, truth, s1).first()["macro_f05"] - want) < 1e-12
