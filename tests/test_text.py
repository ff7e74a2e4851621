from pyspark.sql import functions as F

from kinfold.functions import keys as K
from kinfold.functions import similarity as M
from kinfold.functions import text as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_normalize_text(spark):
    cases = {None: "", "A&B,  Co.": "a and b co", "it’s – ₹5": "it’s – ₹5", "  x\t\ny  ": "x y", "a b": "a b", "": "", "!!!": ""}
    for value, want in cases.items():
        assert one(spark, value, X.normalize_text) == want


def test_vertical_tab_is_no_space(spark):
    assert one(spark, "a\x0bb", X.normalize_text) == "a\x0bb"


def test_normalize_country(spark):
    assert one(spark, " India ", X.normalize_country) == "india"
    assert one(spark, None, X.normalize_country) is None


def test_numbers(spark):
    assert one(spark, "call 9876543210", X.postal) == "987654"
    assert one(spark, "no digits", X.first_number) == ""
    assert one(spark, "12 b 34", X.first_number) == "12"
    assert one(spark, "abc", lambda c: X.word(c, 2)) == ""


def test_keys_are_null_without_country_or_gate(spark):
    df = spark.createDataFrame([(None, "abcdef", "12 main street 12345"), ("us", "abc", "x")], "country_norm string, name_norm string, address_norm string")
    keyed = K.with_selective_keys(K.with_block_keys(df)).collect()
    assert all(keyed[0][k] is None for k in ("block_name_exact", "block_postal", "k_addr_name5", "k_post_name4"))
    assert keyed[1]["block_name_exact"] == "us|abc" and keyed[1]["block_name_prefix5"] is None and keyed[1]["k_addr_w1"] is None


def test_similarity(spark):
    df = spark.createDataFrame([("abcd", "abce"), ("", ""), (None, "a")], "a string, b string")
    got = [r["s"] for r in df.select(M.edit_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [0.75, 1.0, None]
