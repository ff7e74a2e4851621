import duckdb
import pytest

from kinfold.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("pairs_s2", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf)
    r = con.execute(catalog.SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(map(repr, (tuple(x[n] for n in names) for x in df.collect()))) == sorted(map(repr, r.fetchall()))


@pytest.fixture(scope="module")
def got(spark, sf):
    kept = {}

    def rows(name):
        if name not in kept:
            kept[name] = [r.asDict() for r in catalog.QUERIES[name](spark, sf).collect()]
        return kept[name]

    return rows


def table(sf, sql):
    con = duckdb.connect()
    for t in ("train_s1", "train_s2", "train_s3", "train_matches", "documents", "mix_targets"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.execute(sql).fetchall()


RECORDS = "(SELECT * FROM train_s1 UNION ALL SELECT * FROM train_s2 UNION ALL SELECT * FROM train_s3)"


def test_names(got, sf):
    pairs = {(r["name_a"], r["name_b"]) for r in got("p3_found")}
    known = {x for (x,) in table(sf, f"SELECT DISTINCT name_norm FROM {RECORDS}")}
    assert len(pairs) == len(got("p3_found")) > 50 and all(a < b and {a, b} <= known and "" not in (a, b) for a, b in pairs)
    scored = {(r["name_a"], r["name_b"]): r["score"] for r in got("p3_scored")}
    assert set(scored) == pairs and all(0 <= x <= 1 for x in scored.values()) and len(set(scored.values())) > 3


def test_places(got, sf):
    at = {}
    for i, a in table(sf, f"SELECT entity_id, address_norm FROM {RECORDS}"):
        at.setdefault(i, set()).add(a)
    pairs = {(r["id_a"], r["id_b"]) for r in got("p4_found")}
    assert len(pairs) == len(got("p4_found")) > 50 and all(a < b and (len(at[a] | at[b]) > 1) for a, b in pairs)


def test_matches(got, sf):
    labelled = {x for (x,) in table(sf, "SELECT source1_entity_id FROM train_matches")}
    pairs = {(r["s1_id"], r["cand_id"]) for r in got("p6_found")}
    scored = {(r["s1_id"], r["cand_id"]): r["confidence"] for r in got("p6_confidence")}
    assert len(pairs) > 50 and all(a.startswith("S1-") and b[:3] in ("S2-", "S3-") and a not in labelled for a, b in pairs)
    assert set(scored) == pairs and all(0.5 <= c <= 1 for c in scored.values())


def test_ids_of_all_documents(got, sf):
    import public_tokenizers as P
    import tiktoken

    from kinfold.llm import encode

    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encode._ranks(encode.vocabulary_path()), special_tokens={})
    want = {i: whole.encode_ordinary(t or "") for i, t in table(sf, "SELECT doc_id, text FROM documents")}
    assert {r["doc_id"]: r["ids"] for r in got("p7_ids")} == want


def test_mixes(got, sf):
    goals = {s: (t, m) for s, t, m in table(sf, "SELECT * FROM mix_targets")}
    sources = dict(table(sf, "SELECT doc_id, source FROM documents"))
    mixed = got("p8_mix")
    assert len({r["doc_id"] for r in mixed}) == len(mixed) > 0 and all(1 <= r["copies"] <= goals[r["source"]][1] and sources[r["doc_id"]] == r["source"] for r in mixed)
    for name in ("p8_shares", "p8_shares_soft"):
        shares = {r["source"]: r for r in got(name)}
        assert set(goals) <= set(shares) and abs(sum(r["share"] for r in shares.values()) - 1) < 1e-9
    total = sum(r["tokens"] * r["copies"] for r in mixed)
    assert total == sum(r["tokens"] for r in got("p8_shares"))
    assert sum(r["n"] for r in got("p8_holdout")) > 10 and all(0 <= r["accuracy"] <= 1 for r in got("p8_holdout"))


def test_cut_texts(got, sf):
    texts = dict(table(sf, "SELECT doc_id, text FROM documents"))
    cut = {r["doc_id"] for r in got("p9_found")}
    assert cut and all((texts[i] or "").strip() for i in cut)
    assert sum(r["n_cut"] for r in got("p9_rates")) == len(cut) == sum(r["n_cut"] for r in got("p9_paths"))
    assert sum(r["n_docs"] for r in got("p9_rates")) == len(texts)


def test_every_query_is_tested():
    tested = {"p3_found", "p3_scored", "p4_found", "p6_found", "p6_confidence", "p7_ids", "p8_mix", "p8_shares", "p8_shares_soft", "p8_holdout", "p9_found", "p9_rates", "p9_paths"}
    assert tested | set(catalog.SQL) == set(catalog.QUERIES)
