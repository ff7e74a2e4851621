from kinfold.sources import io
from kinfold.sources import schema as S


def test_tsv_round_trip(spark, tmp_path):
    rows = [("S1-1", " a\tb ", 'say "x"', None), ("S1-2", "line\nbreak", "", "US")]
    df = spark.createDataFrame(rows, S.SOURCE)
    io.deliver_tsv(df.repartition(2), str(tmp_path / "t.tsv"), order_by=["entity_id"])
    io.deliver_tsv(df.repartition(2), str(tmp_path / "t.tsv"), order_by=["entity_id"])  # replaces the first
    text = (tmp_path / "t.tsv").read_text()
    assert text.startswith("entity_id\t") and text.index("S1-1") < text.index("S1-2") and not (tmp_path / "t.tsv.parts").exists()
    got = [tuple(r) for r in io.read_tsv(spark, str(tmp_path / "t.tsv"), multi_line=True).orderBy("entity_id").collect()]
    assert got[0] == rows[0] and got[1][:2] == rows[1][:2] and got[1][3] == "US" and not got[1][2]


def test_quoting_off_keeps_marks(spark, tmp_path):
    (tmp_path / "g.tsv").write_text('source1_entity_id\tmatched_entity_ids\nS1-1\t"S2-1,S3-1"\nS1-2\t\n')
    got = [tuple(r) for r in io.read_tsv(spark, str(tmp_path / "g.tsv"), S.TRUTH, quote=None).collect()]
    assert got == [("S1-1", '"S2-1,S3-1"'), ("S1-2", None)]


def test_line_scan_skips_header_and_lines_without_tab(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("source1_entity_id\tmatched_entity_ids\nbroken\nS1-1\ta\tb\n")
    assert [tuple(r) for r in io.read_key_lines(spark, str(tmp_path / "g.tsv")).collect()] == [("S1-1", "a\tb")]


def test_views_and_parquet(spark, tmp_path):
    df = spark.createDataFrame([("S1-1", "S2-1")], S.TRUTH)
    assert io.register(spark, {"gt": df}) == ["gt"] and spark.table("gt").count() == 1
    io.write_parquet(df, str(tmp_path / "p"))
    assert "zstd" in next((tmp_path / "p").glob("*.parquet")).name and spark.read.parquet(str(tmp_path / "p")).count() == 1
    assert io.describe(df).count() == 2


def test_files_without_line_breaks_are_divided(spark, tmp_path):
    df = spark.range(20000).selectExpr("concat('S1-', id) AS entity_id", "repeat('x', 100) AS business_name", "'a' AS business_address", "'us' AS country").select(*S.SOURCE.names)
    io.deliver_tsv(df, str(tmp_path / "t.tsv"), ["entity_id"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        read = io.read_tsv(spark, str(tmp_path / "t.tsv"))
        assert read.rdd.getNumPartitions() > 2 and read.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
