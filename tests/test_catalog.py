import duckdb
import pandas as pd
import pytest

from kinfold.plans import catalog

TABLES = "train_s1 train_s2 train_s3 train_matches aggregated_candidates pairs_s2 documents mix_targets".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    fix = lambda v: None if v is None or v != v else round(v, 9) if isinstance(v, float) else v
    return sorted(repr([fix(v) for v in r]) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    r = con.execute(catalog.SQL[name])
    want = pd.DataFrame(r.fetchall(), columns=[c[0] for c in r.description], dtype=object)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
