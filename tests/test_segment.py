import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.operators import segment as G
from kinfold.session import materialize

FORM = re.compile("S[0-9]+-[0-9]+")
ODD = ["S3-7,2", "S3-8|x", "S3-9;B"]


def test_delimiters_inside_known_values_are_kept():
    auto = G.automaton(set(ODD))
    assert G.segment_text('"S2-1","S3-7,2";S3-8|x|S3-9', FORM, auto) == ["S2-1", "S3-7,2", "S3-8|x", "S3-9"]
    assert G.segment_text("S3-7,23,S2-5", FORM, auto) == ["S3-7", "S2-5"]  # 23 is not the known suffix
    assert G.segment_text("none", FORM, auto) == [] and G.segment_text(None, FORM, auto) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["S2-1", "S2-22", "S3-333", *ODD]), max_size=12), st.sampled_from([",", ";", "|", " | ", "\t", "\n", '","', " and "]))
def test_any_delimiter(values, delimiter):
    assert G.segment_text(delimiter.join(values), FORM, G.automaton(set(ODD))) == values


def test_cover_prefers_characters_then_few_pieces():
    assert G.best_cover([(0, 2), (2, 4), (0, 4)]) == [(0, 4)]
    assert G.best_cover([(0, 3), (2, 8), (8, 9)]) == [(2, 8), (8, 9)]


def test_operator(spark):
    rng = random.Random(1)
    long = [f"S2-{rng.randrange(10**6)}" for _ in range(20000)]
    rows = [("a", "S2-1, S3-7,2", 1), ("a", "S2-1, S3-7,2", 2), ("b", None, 1), ("c", "", 1), ("d", "S2-1;S2-1", 1), ("e", "|".join(long), 1), ("f", "N/A", 1)]
    df = spark.createDataFrame(rows, "id string, packed string, value int")
    ids = spark.createDataFrame([(x,) for x in [*ODD, "S2-1", "S3-7,2", None]], "entity_id string")
    got = {}
    for r in G.segment(df, ["id"], "packed", ids, "S[0-9]+-[0-9]+").collect():
        got.setdefault(r["id"], {})[r["pos"]] = r["value"]
    assert got["a"] == {1: "S2-1", 2: "S3-7,2"} and got["d"] == {1: "S2-1", 2: "S2-1"}
    assert [got["e"][i + 1] for i in range(len(long))] == long and set(got) == {"a", "d", "e"}


def test_empty(spark):
    df = spark.createDataFrame([], "id string, packed string")
    assert G.segment(df, ["id"], "packed", spark.createDataFrame([], "v string"), "S[0-9]+-[0-9]+").count() == 0


def test_known_values_of_no_general_form(spark):
    """The automaton finds what the pattern alone cannot: delimiters and spaces inside values, and values of any form."""
    known = ["ACME; Sons", "ACME", "a|b", "S3-7,2", "S3-70", "--"]
    rows = [("a", "ACME; Sons;ACME,S3-7,2|S3-7"), ("b", "a|b|ACMEX|S3-700"), ("c", "x, y")]
    df = spark.createDataFrame(rows, "id string, packed string")
    got = G.segment(df, ["id"], "packed", spark.createDataFrame([(x,) for x in known], "v string"), "S[0-9]+-[0-9]+").orderBy("id", "pos").collect()
    assert [(r["id"], r["value"]) for r in got] == [("a", "ACME; Sons"), ("a", "ACME"), ("a", "S3-7,2"), ("a", "S3-7"), ("b", "a|b"), ("b", "S3-700")]
    assert FORM.findall(rows[0][1]) == ["S3-7", "S3-7"]


def test_links_of_lists_in_any_writing(spark):
    from kinfold.operators import truth as L

    t = spark.createDataFrame([("a", "['S2-1', 'S3-7,2']"), ("a", "S2-1|S2-9"), ("b", None), ("c", "n/a")], "source1_entity_id string, matched_entity_ids string")
    ids = spark.createDataFrame([("S2-1",), ("S3-7,2",), ("S3-7,2",)], "entity_id string")
    assert sorted(map(tuple, L.read_links(t, ids).collect())) == [("a", "S2-1"), ("a", "S2-9"), ("a", "S3-7,2")]


def test_exploded_lists_are_never_broadcast(spark):
    lists = materialize(spark.createDataFrame([("a", "S2-1,S3-2"), ("b", "S2-3;odd")], "k string, packed string"))
    known = materialize(spark.createDataFrame([("S2-1",), ("odd",)], "id string"))
    out = G.segment(lists, ["k"], "packed", known, "S[0-9]+-[0-9]+")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [anchor_" in plan and "BroadcastHashJoin [anchor_" not in plan
    assert sorted((r["k"], r["value"]) for r in out.collect()) == [("a", "S2-1"), ("a", "S3-2"), ("b", "S2-3"), ("b", "odd")]
