import itertools
import random

from pyspark.sql import functions as F

from kinfold.llm import addresses as A
from kinfold.llm.graph import near
from kinfold.llm.names import edits
from kinfold.session import materialize


def test_reading():
    base = A.read("53 dupeskin drive nuquenburg ts 82897", "us")
    for other in ("unit 34 53 dupeskin drv nuquenburg 82897", "82897 4411 nuquenburg no 53 dupeskin dr", "53 a dupeskin drive next to clock tower nuquenburg tessaly 82897", "0053 dupeskin drive nuquenburg 82897", "dupeskin drive 53 nuquenburg 82897", "shop no 3 h no 53 du peskin drive nuquenburg 82897"):
        assert A.read(other, "us") == base
    assert A.read("fupluzasallee 43 52404 thadralbruck", "germany") == A.read("43 fupluzas al thadralbruck ow 52404", "germany")
    assert A.read("seventeen wotripit x gutrulabad 720 770", "india") == A.read("17 wotripit cross gutrulabad bn 720770", "india")
    for none in ("", "drithun springs 36916", "n a", "litholton"):
        assert A.read(none, "us") is None


def test_other_place_is_other():
    base = A.read("53 dupeskin drive nuquenburg 82897", "us")
    for other in ("54 dupeskin drive nuquenburg 82897", "53 dupeskin lane nuquenburg 82897", "53 morkalet drive nuquenburg 82897", "53 dupeskin drive litholton 11111"):
        assert A.read(other, "us") != base


def test_operator(spark):
    one = ["53 dupeskin drive nuquenburg ts 82897", "53 dupeskni drv nuquenburg 82897", "82897 nuquenburg unit 3 53 dupeskin dr", "53 dupeskin drive nuquenburg"]
    other = ["54 dupeskin drive nuquenburg ts 82897", "53 dupeskin lane nuquenburg ts 82897", "53 dupeskin drive litholton ts 11111"]
    rows = [(f"S1-{i}", a, "us") for i, a in enumerate(one)] + [(f"S2-{i}", a, "us") for i, a in enumerate(other)]
    rows += [("S3-0", None, "us"), ("S3-1", "", "us"), ("S3-2", "n a", None), ("S3-3", "word " * 5000, "us"), ("S3-4", one[0], "us"), ("S3-4", one[0], "us"), (None, "nuquenburg", "us")]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "entity_id string, address string, country string, num string, building int")
    got = {tuple(r) for r in A.same_building(df).collect()}
    ids = ["S1-0", "S1-1", "S1-2", "S1-3", "S3-4"]
    want = {p for p in itertools.combinations(ids, 2) if p != ("S1-0", "S3-4")}
    assert got == want


def test_a_street_without_town_joins_only_one_building(spark):
    rows = [("a", "53 dupeskin drive nuquenburg 82897"), ("b", "53 dupeskin drive litholton 11111"), ("c", "53 dupeskin drive")]
    assert A.same_building(spark.createDataFrame([(*r, "us") for r in rows], "entity_id string, address string, country string")).count() == 0


def test_empty(spark):
    assert A.same_building(spark.createDataFrame([], "entity_id string, address string, country string")).count() == 0


def _misspelt(word, rng):
    i, c = rng.randrange(1, len(word) - 1), rng.choice("bdfhjnprtuz")
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]])


def test_building_of_many_readings(spark):
    rng = random.Random(1)
    main = "53 dupeskin drive nuquenburg 82897"
    rows = {main: 40} | {f"53 {s} drive {t} 82897": 1 for s, t in [("dupeskin", _misspelt("nuquenburg", rng)) for _ in range(300)] + [(_misspelt("dupeskin", rng), "nuquenburg") for _ in range(300)] if len(A.read(f"53 {s} drive {t} 82897", "us")[3]) > 7}
    rows |= {"53 morkalet drive nuquenburg 82897": 9, "53 bantrivol drive nuquenburg 82897": 9}
    assert len({A.read(a, "us")[1:] for a in rows}) > 200
    out = A.buildings(spark.createDataFrame([(a, "us", n) for a, n in rows.items()], "address string, country string, n int")).collect()
    of = {r["address"]: r["building"] for r in out}
    others = {"53 morkalet drive nuquenburg 82897", "53 bantrivol drive nuquenburg 82897"}
    alike = [a for a in of if a not in others and all(edits(x, y) < 2 for x, y in zip(A.read(a, "us")[1:], A.read(main, "us")[1:]))]
    assert len(alike) > 200 and {of[a] for a in alike} == {of[main]}
    assert len({of[a] for a in others} | {of[main]}) == 3


def test_keys_meet_all_near(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdr") for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    words = sorted({*words, *(w for x in words for w in (_misspelt(_misspelt(x + "abc", rng), rng), x + "abc", x[::-1], x[1:] + x[:1]) if w)})
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.explode(A._bits("w")[0]).alias("i")).groupBy("w").agg(F.collect_set(A._bits("w")[1]).alias("keys"))
    x, y = df.select(F.col("w").alias("v"), F.col("keys").alias("other")), df
    loose = (F.least(F.length("v"), F.length("w")) >= 6) & (F.levenshtein("v", "w", 2) >= 0)
    pairs = x.join(y, F.col("v") < F.col("w")).filter(near(F.col("v"), F.col("w")) | loose)
    assert pairs.count() > 300
    assert pairs.filter(~F.arrays_overlap("keys", "other")).collect() == []


def test_rarity_is_relative(spark):
    def apart(k, *counts):
        rows = [(f"53 {s} drive nuquenburg 82897", "us", n) for s, n in zip(("dupeskinbarot", "dupezkinbanot"), counts)]
        rows += [(f"{i} morkalet road litholton 11111", "us", k) for i in range(1, 6)]  # most addresses are on one record
        return len({r["building"] for r in A.buildings(spark.createDataFrame(rows, "address string, country string, n int")).filter("address LIKE '53 %'").collect()}) == 2

    assert [apart(k, 100 * k, 4 * k) for k in (1, 10)] == [False, False]
    assert [apart(k, 10 * k, 8 * k) for k in (1, 10)] == [True, True]


def test_result_does_not_depend_on_how_often_all_records_are_counted(spark, sf):
    t = spark.read.parquet(f"{sf}/train_s3.parquet").filter("address_norm <> ''").groupBy("address_norm", "country_norm").count().toDF("address", "country", "n")
    got = [{(r["address"], r["country"]): r["building"] for r in A.buildings(t.withColumn("n", t["n"] * k)).collect()} for k in (1, 10)]
    assert got[0] == got[1] and len(got[0]) > 100


def test_growing_tables_are_never_broadcast(spark, monkeypatch):
    plans = []

    def seen(df, label="step"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, label)

    monkeypatch.setattr(A, "materialize", seen)
    rows = [(f"e{i}", f"{i % 5 + 1} mulberitz strasse {t} 12345", "germany") for i, t in enumerate(["kobenstadt", "kobenstat", "kobnstadt"] * 5)]
    out = A.same_building(spark.createDataFrame(rows, "entity_id string, address string, country string"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    # The usual town of a code is looked up in a table of codes, which may be broadcast.
    joins = [line for x in plans for line in x.splitlines() if "Join" in line and "[code#" not in line]
    assert sum("SortMergeJoin" in x for x in joins) >= 4 and not any("BroadcastHashJoin" in x for x in joins)
    assert out.count() > 0
