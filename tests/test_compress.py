from collections import Counter

from kinfold.operators import compress as Z


def test_profile_against_brute_force(spark):
    rows = [("hot", f"v{i % 7}") for i in range(500)] + [("hot", None)] * 3 + [("a", "x"), ("a", "y"), ("b", None), (None, "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k string, v string, freq int")  # a clashing extra column
    got = {r["k"]: tuple(r)[1:] for r in Z.key_profile(Z.compress(df, ["k"], "v"), ["k"], "v").collect()}
    for k in {r[0] for r in rows}:
        values = Counter(v for a, v in rows if a == k and v is not None)
        mode = min(values, key=lambda v: (-values[v], v)) if values else None
        assert got[k] == (sum(a == k for a, _ in rows), len(values), mode, values[mode] if values else None)


def test_heavy_keys_count_rows_without_key(spark):
    rows = [("t", None, "x")] * 98 + [("t", "a", "x")] * 2 + [("u", "a", "x")] * 49 + [("u", "b", "x")]
    df = spark.createDataFrame(rows, "t string, k string, v string")
    got = {(r["t"], r["k"]) for r in Z.heavy_keys(Z.compress(df, ["t", "k"], "v"), "t", "k", 0.02).collect()}
    assert got == {("t", "a"), ("u", "a"), ("u", "b")}


def test_percentiles(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 10, 50)] + [("b", None)], "k string, x int")
    got = {r["k"]: (r["p50"], r["p90"]) for r in Z.key_percentiles(df, ["k"], "x", [0.5, 0.9]).collect()}
    assert got == {"a": (3.0, 34.0), "b": (None, None)}


def test_empty(spark):
    df = spark.createDataFrame([], "k string, v string")
    assert Z.key_profile(Z.compress(df, ["k"], "v"), ["k"], "v").count() == 0
