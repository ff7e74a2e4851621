import random

from pyspark.sql import functions as F

from kinfold.operators import classify as C
from kinfold.operators import score as S
from kinfold.operators import tokens as T
from kinfold.plans import catalog


def test_features(spark):
    schema = "entity_id string, name_norm string, address_norm string"
    a = spark.createDataFrame([("a", "red shop ltd", "12 main road 12345"), ("e", "", "")], schema)
    b = spark.createDataFrame([("x", "red shop", "12 main street 12345"), ("y", "", "")], schema)
    pairs = spark.createDataFrame([("a", "x", "S2"), ("e", "y", "S2"), ("a", "y", "S2")], "s1_id string, cand_id string, cand_source string")
    got = {(r["s1_id"], r["cand_id"]): r for r in S.pair_features(pairs, a, b).collect()}
    r = got["a", "x"]
    assert (r["name_overlap"], r["name_contained"], r["number_match"], r["postal_match"], r["numbers_overlap"], r["street_overlap"]) == (2, True, True, True, 2, 1)
    assert abs(r["name_jaccard"] - 2 / 3) < 1e-12 and abs(r["name_similarity"] - (1 - 4 / 12)) < 1e-12
    assert got["e", "y"]["name_jaccard"] == 0 and not got["a", "y"]["name_contained"]


def test_labels_splits_and_validation(spark):
    pairs = spark.createDataFrame([("a", "x"), ("a", "y")], "s1_id string, cand_id string")
    links = spark.createDataFrame([("a", "x"), ("a", "x")], "s1_id string, cand_id string").distinct()
    assert {(r["cand_id"], r["is_match"]) for r in S.label_pairs(pairs, links).collect()} == {("x", True), ("y", False)}
    assert S.split_by_entity(pairs, "s1_id", 3).select("fold").distinct().count() == 1
    s1 = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    packed = spark.createDataFrame([("a", "x"), ("a", "x")], "source1_entity_id string, candidate_entity_ids string")
    stray = spark.createDataFrame([("a", "z")], "s1_id string, cand_id string")
    assert tuple(S.validate(packed, s1, stray, pairs).first()) == (2, 2, 1, 1, 1)


def test_classifier_on_held_out_entities(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        for j in range(3):
            m = j == 0
            rows.append((f"s{i}", f"c{i}-{j}", m, rng.uniform(0.6, 1) if m else rng.uniform(0, 0.7), rng.random(), 2 if m else 0, 0.5, m, m, False, 1, rng.randrange(3)))
    df = spark.createDataFrame(rows, ["s1_id", "cand_id", "is_match", *C.FEATURES])
    r = C.precision_recall(C.fit_and_score(df, trees=3, depth=2), [0.5]).first()
    assert r["pairs"] > 0 and r["precision"] > 0.95 and r["recall"] > 0.95
    assert C.fit_and_score(df.filter("is_match")).count() == 0


def test_rare_tokens(spark):
    e = spark.createDataFrame([("a", "x", "blue limited lamp shop", "limited blue lamp")], "s1_id string, cand_id string, a_name_norm string, b_name_norm string")
    f = spark.createDataFrame([("blue", 5), ("lamp", 50), ("limited", 1)], "token string, frequency long")
    assert {(r["cap"], r["hits"]) for r in T.rare_token_hits(e, f, [4, 5, 50]).collect()} == {(4, 0), (5, 1), (50, 1)}


def test_name_similarity_of_all_pairs(spark, tmp_path):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    names = {1: ["café müller", "москва шоп", "red shop"], 2: ["cafe müler", "москва шопы"], 3: ["café muller", "red shop €", "東京 shop"]}
    for n, own in names.items():
        rows = [(f"S{n}-{i}", x, x, f"12 main road {x}", f"12 main road {x}", "us", "us") for i, x in enumerate(own)]
        spark.createDataFrame(rows, "entity_id string, name string, name_norm string, address string, address_norm string, country string, country_norm string").withColumns(
            {c: F.lit("same") for c in ("block_name_exact", "block_address_exact", "block_name_prefix5", "block_address_prefix8", "block_postal")}).write.parquet(f"{tmp_path}/train_s{n}.parquet")
    got = {(r["s1_id"], r["cand_id"]): r["name_similarity"] for r in catalog.QUERIES["features_name_similarity"](spark, str(tmp_path)).collect()}
    of = {f"S{n}-{i}": x for n, own in names.items() for i, x in enumerate(own)}
    pairs = {(r["s1_id"], r["cand_id"]) for r in catalog.QUERIES["pairs_slim"](spark, str(tmp_path)).collect()}
    assert pairs and set(got) == pairs and any(not of[a].isascii() for a, _ in pairs)
    assert all(abs(s - (1 - edits(of[a], of[b]) / max(len(of[a]), len(of[b])))) < 1e-12 for (a, b), s in got.items())


def test_classifier_is_fitted_on_all_pairs(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    seen, fit = [], GBTClassifier.fit

    def spy(self, data):
        # Without weights a row is a pair; Spark samples thresholds of more rows than bins squared or 10,000.
        seen.append((data.selectExpr(f"sum({self.getWeightCol() if self.isDefined('weightCol') else 1})").first()[0], data.count(), self.getMaxBins()))
        return fit(self, data)

    monkeypatch.setattr(GBTClassifier, "fit", spy)
    n = F.col("id")
    names = {f: (n % 97 / 97 if f == "name_similarity" else n % 211 / 211 if f == "name_length_ratio" else n % 2) for f in C.FEATURES}
    df = spark.range(300_000).select(n.cast("string").alias("s1_id"), n.cast("string").alias("cand_id"), (n % 97 > 60).alias("is_match"), *[c.alias(f) for f, c in names.items()])
    train = C.folded(df).filter("fold > 0").count()
    out = [C.precision_recall(C.fit_and_score(x, trees=1, depth=2), [0.5]).first() for x in (df, C.weighted(df))]
    assert train > 200_000 and [x[0] for x in seen] == [train, train] and all(rows <= max(bins**2, 10_000) for _, rows, bins in seen)
    assert out[0] == out[1] and out[0]["pairs"] > 0
