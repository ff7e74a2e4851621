import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.llm import graph
from kinfold.llm import names as N
from kinfold.session import materialize


def same(a, b):
    return bool(set(N.forms(a)) & set(N.forms(b)))


def test_rules():
    assert same("the kaplel and grochu bakery kg", "m s grochu kaplel bakery k g")
    assert same("gl venky saweck plumbing inc", "plumbing services global venkatesh saweck l l c")
    assert same("sovoxfuvex cycle mart", "sovox fuvex cycle mart llc")
    assert same("ted ruvock catering", "theodore ruvock catering") and same("ted ruvock catering", "edward ruvock catering")
    assert same("alexander kobrin security sys litholton", "kobrin alexander security systems")
    assert same("düthex roofing contr", "duthex roofing contractors")


def test_other_business_is_other():
    assert not same("kaplel bakery", "kaplel roofing contractors")
    assert not same("kaplel and sons bakery", "kaplel and daughters bakery")
    assert not same("global kaplel bakery", "royal kaplel bakery")
    assert not same("stole dental care", "stole auto repair")
    assert N.forms("n a") == N.forms("") == N.forms("unknown") == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcd", max_size=7), st.text(alphabet="abcd", max_size=7))
def test_edits(a, b):
    def full(x, y):
        d = {(i, 0): i for i in range(len(x) + 1)} | {(0, j): j for j in range(len(y) + 1)}
        for i, j in itertools.product(range(1, len(x) + 1), range(1, len(y) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x[i - 1] != y[j - 1]))
            if i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(x), len(y)]

    assert N.edits(a, b) == min(full(a, b), 3)


def test_operator(spark):
    rows = ["zalipron bakery"] * 5 + ["zalipron bakery llc", "zaliprn bakery", "bakery zalipron", "zalipron brewery", None, "", "n a", "unknown", "x" * 20000, "morvekul travel", "morvekul travel agency"]
    df = spark.createDataFrame([(r, 1, 7) for r in rows], "name string, n int, node int")
    got = {tuple(r) for r in N.same_organisation(df).collect()}
    group = ["bakery zalipron", "zaliprn bakery", "zalipron bakery", "zalipron bakery llc"]
    assert got == set(itertools.combinations(group, 2)) | {("morvekul travel", "morvekul travel agency")}


def test_empty(spark):
    assert N.same_organisation(spark.createDataFrame([], "name string, n int")).count() == 0


def test_rarity_is_relative(spark):
    def apart(k, *counts):
        # Most names of a corpus are on one record; it may count every record k times.
        rows = list(zip(("sunbarodit express", "sunbarozif express"), counts)) + [(f"{w} bakery", k) for w in ("velmor", "tokanu", "rishpad", "gumblex", "yanquot")]
        return len({r["root"] for r in N.name_groups(spark.createDataFrame(rows, "name string, n int")).filter("name LIKE 'sun%'").collect()}) == 2

    assert [apart(k, 30 * k, 3 * k) for k in (1, 10)] == [False, False]
    assert [apart(k, 10 * k, 8 * k) for k in (1, 10)] == [True, True]


def test_many_own_words_in_any_order():
    a, b = N.forms("merle shumo tavi rokan bakery"), N.forms("rokan tavi shumo merle bakery")
    assert {x[3] for x in a} & {x[3] for x in b}


def test_result_does_not_depend_on_how_often_all_records_are_counted(spark, sf):
    t = spark.read.parquet(f"{sf}/train_s2.parquet").filter("name_norm <> ''").groupBy("name_norm").count().toDF("name", "n")
    pairs = lambda k: {tuple(r) for r in N.same_organisation(t.withColumn("n", t["n"] * k)).collect()}
    assert pairs(1) == pairs(10)


def test_the_heaviest_near_spelling_is_found_among_others_under_its_key(spark):
    """Of the forms that begin alike, the near one is neither the commonest of all nor the next before."""
    rows = [("bardonubes bakery", 100), ("bardonikto bakery", 50), ("bardonafir bakery", 20), ("bardonekta bakery", 1)]
    got = {r["name"]: r["root"] for r in N.name_groups(spark.createDataFrame(rows, "name string, n int")).collect()}
    assert got["bardonekta bakery"] == got["bardonikto bakery"] and len(set(got.values())) == 3


def _keys(form):
    six = {"<" + form[:6], ">" + form[-6:]} if len(form) >= 8 else set()
    return six | {form} | ({form[:i] + form[i + 1 :] for i in range(len(form))} if len(form) >= 3 else set())


@pytest.mark.parametrize("crowd, long", [(64, 24), (2, 24), (0, 24), (2, 4)])
def test_all_forms_under_a_key_meet(spark, monkeypatch, crowd, long):
    """Whether a key is crowded or its rests are long makes no difference to pairs within two edits."""
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choices("abo", k=n))
    forms = [(k, k % 2, rnd.choice(["bardon" + word(rnd.randint(2, 6)), word(rnd.randint(0, 5)) + "bardon", word(rnd.randint(1, 4))])) for k in range(150)]
    monkeypatch.setattr(N, "CROWD", crowd)
    monkeypatch.setattr(N, "LONG", long)
    got = {tuple(r) for r in N._meetings(spark.createDataFrame(forms, "node long, about long, form string")).collect()}
    shared = {(a[0], b[0]) for a, b in itertools.combinations(forms, 2) if a[1] == b[1] and _keys(a[2]) & _keys(b[2])}
    form = {k: f for k, _, f in forms}
    near = {(a, b) for a, b in shared if N.edits(form[a], form[b]) <= 2}
    assert near <= got <= shared and len(near) > 400
    assert crowd < 64 or got == shared


def test_growing_tables_are_never_broadcast(spark, monkeypatch):
    plans = []

    def seen(df, label="step"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, label)

    for module in (N, graph):
        monkeypatch.setattr(module, "materialize", seen)
    monkeypatch.setattr(N, "CROWD", 1)
    names = ["merleshumo bakery", "merlshumo bakery", "merleshuma bakery", "merleshumolin bakery", "merleshumolon bakery", "vantrebolux shoes"]
    df = spark.createDataFrame([(x, 1) for x in names], "name string, n long")
    nodes = N.rewritings(df).select("node", F.lit(0).cast("long").alias("about"), F.explode(F.split("forms", r"\|")).alias("form"))
    out = [N._meetings(nodes), N.same_organisation(df), N.same_organisation(df, scored=True)]
    plans += [x._jdf.queryExecution().executedPlan().toString() for x in out]
    assert sum("SortMergeJoin" in x for x in plans) >= 5 and not any("BroadcastHashJoin" in x for x in plans)
    assert out[1].count() > 0
