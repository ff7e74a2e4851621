import pytest

from kinfold import session as S


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, "a", [1, 2]), (None, None, None)], "i long, s string, a array<int>")
    back = S.materialize(df, "test")
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    assert "LogicalRDD" not in back._jdf.queryExecution().analyzed().toString()


def test_scratch_is_in_the_shared_folder(spark):
    assert S.scratch_path(spark, "x").startswith(S.shared_dir(spark))
    assert S.scratch_path(spark, "x") != S.scratch_path(spark, "x")


def test_a_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        S.shared_dir(Session())


def test_map_columns(spark):
    df = spark.range(5)
    got = S.map_columns(df, lambda b: {"y": [x * 2 for x in b["id"] if x % 2], "z": [None if x == 1 else "s" for x in b["id"] if x % 2]}, "y long, z string")
    assert sorted(map(tuple, got.collect())) == [(2, None), (6, "s")]
    assert S.map_columns(spark.range(0), lambda b: {"y": b["id"]}, "y long").count() == 0
