import re

from pyspark.sql import functions as F

from kinfold.llm import linkage as K

SCHEMA = "entity_id string, name string, address string, country string, src int, root string, e double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0.5) for r in rows], SCHEMA)


def test_link(spark):
    at, moved = "53 dupeskin drive nuquenburg ts 82897", "7 morkalet road litholton 11111"
    rows = [
        ("S1-1", "zalipron bakery llc", at, "us", 1), ("S1-2", "sunmarro express", at, "us", 1), ("S1-3", "sunmarro express", moved, "us", 1), ("S1-4", None, None, "us", 1),
        ("S2-1", "zalipron bakery", at, "us", 2), ("S2-2", "zaliprn bakery", moved, None, 2), ("S2-3", "bakery zalipron", None, "us", 2),
        ("S2-4", "sunmarro express", "unit 4 " + at, "us", 2), ("S3-5", "sun marro express", moved, "us", 3), ("S3-6", "kelbrum roofing", at, "us", 3), ("S3-7", None, "", None, 3),
        ("S3-8", "x" * 5000, "y " * 3000, "us", 3), ("S2-1", "zalipron bakery", at, "us", 2),
    ]
    got = {(r["s1_id"], r["cand_id"]): r["confidence"] for r in K.link(frame(spark, rows)).collect()}
    assert set(got) == {("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-1", "S2-3"), ("S1-2", "S2-4"), ("S1-3", "S3-5")}
    assert all(0.5 <= v <= 1 for v in got.values())


def test_exclusivity(spark):
    pairs = spark.createDataFrame([("a", 1, 1, 0.9), ("b", 1, 1, 0.6), ("c", 2, None, 0.9)], "s1_id string, root long, building long, e double")
    got = {r["s1_id"]: r["confidence"] for r in K.solve(pairs, steps=24).collect()}
    assert abs(got["a"] + got["b"] - 1) < 0.05 and got["a"] - got["b"] > 0.25 and abs(got["c"] - 0.9) < 1e-9


def test_known_links_take_their_records(spark):
    at = "53 dupeskin drive nuquenburg ts 82897"
    rows = [("S1-1", "zalipron bakery", at, "us", 1), ("S1-2", "zalipron bakery", "", "us", 1), ("S2-1", "zalipron bakery", at, "us", 2)]
    known = spark.createDataFrame([("S1-2", "S2-1")], "s1_id string, cand_id string")
    got = {(r["s1_id"], r["cand_id"]) for r in K.link(frame(spark, rows), known).collect()}
    assert ("S1-1", "S2-1") not in got


def test_empty(spark):
    assert K.link(frame(spark, [])).count() == 0


def test_accuracy_on_labelled_records(spark):
    """The labels are not used; matches of labelled S1 records are held against them."""
    d = "/root/testdata/sf0.01"
    one = lambda n: spark.read.parquet(f"{d}/train_s{n}.parquet").select("entity_id", F.col("name_norm").alias("name"), F.col("address_norm").alias("address"), F.col("country_norm").alias("country"), F.lit(n).alias("src"))
    records = one(1).unionByName(one(2)).unionByName(one(3))
    ids = {r["entity_id"] for r in records.select("entity_id").distinct().collect()}
    truth, labelled = set(), set()
    for r in spark.read.parquet(f"{d}/train_matches.parquet").collect():
        labelled.add(r[0])
        truth |= {(r[0], x) for x in re.findall(r"S[23]-\d{8}", r[1] or "") if x in ids}
    got = {(r["s1_id"], r["cand_id"]) for r in K.link(records).collect() if r["s1_id"] in labelled and re.fullmatch(r"S[23]-\d{8}", r["cand_id"])}
    assert len(got & truth) >= 0.97 * len(got) and len(got & truth) >= 0.95 * len(truth)


def test_steps_end_by_themselves(spark):
    """With the default end the values are those of many steps: no decision differs and none is far off."""
    pairs = spark.createDataFrame([("a", 1, 1, 0.9), ("b", 1, 1, 0.6), ("a", 2, 1, 0.4), ("d", 2, 2, 0.7), ("b", 3, 1, 0.95)], "s1_id string, root long, building long, e double")
    values = lambda **how: {(r["s1_id"], r["root"], r["building"]): r["confidence"] for r in K.solve(pairs, **how).collect()}
    got, full = values(), values(steps=200, tolerance=0.0)
    assert all(abs(got[k] - full[k]) < 0.05 and (got[k] >= 0.5) == (full[k] >= 0.5) for k in full) and len(got) == 5


def test_a_rare_spelling_finds_its_records_among_names_that_begin_alike(spark):
    """The near name is neither the commonest of those that begin alike nor the next before the rare one."""
    names = ["bardonubes"] * 6 + ["bardonikto"] * 4 + ["bardonafir"] * 2
    rows = [(f"S2-{i}", f"{w} bakery", f"{10 + i} dupeskin drive nuquenburg ts 82897", "us", 2) for i, w in enumerate(names)]
    rows.append(("S1-1", "bardonekta bakery", "7 morkalet road litholton 11111", "us", 1))
    assert {(r["s1_id"], r["cand_id"]) for r in K.link(frame(spark, rows)).collect()} == {("S1-1", f"S2-{i}") for i in range(6, 10)}
