from kinfold.functions import keys as K
from kinfold.sources import io
from kinfold.streaming import incremental as I


def test_stream_equals_batch(spark, tmp_path):
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    (source / "1.tsv").write_text(head + "S1-1\tA&B Co.\t12 Main St 12345\tUS\n")
    I.write_keyed(I.keyed_stream(I.read_sources(spark, str(source))), target, state).awaitTermination(60)
    (source / "2.tsv").write_text(head + "S1-2\t\tn/a\t\n")
    I.write_keyed(I.keyed_stream(I.read_sources(spark, str(source))), target, state).awaitTermination(60)
    batch = K.with_block_keys(K.normalized(io.read_tsv(spark, str(source))))
    rows = lambda df: sorted(map(repr, map(tuple, df.select(batch.columns).collect())))
    assert rows(spark.read.parquet(target)) == rows(batch)
