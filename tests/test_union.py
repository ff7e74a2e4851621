"""Pairs and counts of entities on odd records: several versions of one id, equal words, short names, no codes."""

import itertools
import random

import pytest

from kinfold.operators import blocking as B
from kinfold.operators import score as S
from kinfold.plans import catalog

SCHEMA = "entity_id string, country_norm string, name_norm string, address_norm string"


def made(rng, source, n, versions):
    words = ["", "red", "blue", "bluefish", "shop", "bluer"]
    name = lambda: " ".join(w for w in (rng.choice(words), rng.choice(words)) if w)
    place = lambda: rng.choice(["", "1 main", "1 main 12345", "2 side 12345", "main", "12345 1", "2 side 123456"])
    ids = [f"S{source}-{i}" for i in range(n)] + [f"S{source}-{i}" for i in range(0, n, 7) if versions]
    return [(i, rng.choice(["us", "us", "us", "in", None]), name(), place()) for i in ids]


@pytest.fixture(scope="module", params=[False, True], ids=["single", "versions"])
def folder(request, spark, tmp_path_factory):
    rng, path = random.Random(3), str(tmp_path_factory.mktemp("odd"))
    for s in (1, 2, 3):
        spark.createDataFrame(made(rng, s, 60, request.param), SCHEMA).write.parquet(f"{path}/train_s{s}.parquet")
    return path


def brute(spark, folder, n):
    a, b = (B.keyed(spark.read.parquet(f"{folder}/train_s{s}.parquet")).collect() for s in (1, n))
    out = {}
    for x, y in itertools.product(a, b):
        mask = {g for _, l, r, g in B.RULES if x[l] is not None and x[l] == y[r]}
        if mask:
            out.setdefault((x["entity_id"], y["entity_id"]), set()).update(mask)
    return out


def test_pairs_come_once(spark, folder):
    for n in (2, 3):
        got = catalog.QUERIES[f"pairs_fired_s{n}"](spark, folder).collect()
        assert {(r["s1_id"], r["cand_id"]): {f for f in B.FLAGS if r[f]} for r in got} == brute(spark, folder, n)
        assert len(got) == len({(r["s1_id"], r["cand_id"]) for r in got})
        flagged = catalog.QUERIES[f"pairs_flagged_s{n}"](spark, folder).select("s1_id", "cand_id").collect()
        assert sorted(flagged) == sorted((r["s1_id"], r["cand_id"]) for r in got)


def test_pairs_of_a_rule_come_once(spark, folder):
    for name, l, r, _ in B.RULES:
        a, b = (B.keyed(spark.read.parquet(f"{folder}/train_s{s}.parquet")).collect() for s in (1, 2))
        b += B.keyed(spark.read.parquet(f"{folder}/train_s3.parquet")).collect()
        want = {(x["entity_id"], y["entity_id"]) for x, y in itertools.product(a, b) if x[l] is not None and x[l] == y[r]}
        assert sorted(map(tuple, catalog.QUERIES[f"rule_{name}"](spark, folder).collect())) == sorted(want)


def shuffled_pairs(df):
    """Exchanges above a join on the key of a rule."""
    plan, above = df._jdf.queryExecution().optimizedPlan().toString(), 0
    for line in plan.splitlines():
        if "Join Inner" in line and "key#" in line:
            return above
        above += "Aggregate" in line or "Join" in line
    raise AssertionError("no join on a key")


def test_pairs_are_not_shuffled(spark, sf):
    for name in ("pairs_flagged_s2", "pairs_fired_s3", "pairs_slim", "rule_post_name4", "features_pairs", "features_name_similarity"):
        assert shuffled_pairs(catalog.QUERIES[name](spark, sf)) == 0, name


def test_counts_of_the_union(spark, folder):
    want = {}
    for n in (2, 3):
        for a, _ in brute(spark, folder, n):
            want.setdefault(a, [0, 0])[n - 2] += 1
    got = {r["entity_id"]: [r["s2_cands"], r["s3_cands"]] for r in catalog.QUERIES["audit_counts"](spark, folder).collect()}
    assert {k: v for k, v in got.items() if v != [0, 0]} == want and len(got) == 60


def test_counts_make_no_pair(spark, sf):
    """A hundred thousand pairs of one key are counted from two rows of a histogram."""
    for name in ("audit_counts", "audit_distribution", "audit_recall", "audit_validation", "score_macro_f05"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert not any("Join Inner" in line and "cand_id" not in line and "s1_id" not in line and "key#" in line for line in plan.splitlines()), name


def test_features_equal_those_by_ids(spark, folder):
    one, two = (B.keyed(spark.read.parquet(f"{folder}/train_s{n}.parquet")) for n in (1, 2))
    want = S.pair_features(catalog.QUERIES["pairs_fired_s2"](spark, folder).select("s1_id", "cand_id", "cand_source"), one, two)
    got = catalog._features(spark, folder, one).filter("cand_source = 'S2'")
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
