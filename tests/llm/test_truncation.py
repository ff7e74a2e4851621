import random

import numpy as np
import pytest

from kinfold.llm import truncation as T


def sentence(rng):
    a, b = rng.choice(["copper", "nylon", "walnut", "rubber"]), rng.choice(["hinge", "router", "saddle", "filter"])
    return rng.choice([f"I measured the {a} {b} yesterday and it was still fine", f"Does a {a} {b} really need {rng.randrange(90)} screws or is that for show", f"My neighbour told me to replace the {b} before the weekend because it leaked"])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    return [(i, " ".join(sentence(rng) + "." for _ in range(rng.randrange(2, 6))), "forum") for i in range(400)]


def flags(spark, rows):
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, text string, source string, gram string, cut boolean")
    out = T.truncated(df).collect()
    return {r["doc_id"]: r["cut"] for r in out}, out


def test_cut_and_careless_ends(spark, corpus):
    cases = {
        1001: ("I measured the copper hinge yesterday and it was", True), 1002: ("My neighbour told me to replace the saddle before the week", True), 1003: ("I measured the nylon filter yesterday and it was still fine", False),
        1004: ("My neighbour told me to replace the router before the weekend because (truncated)", True), 1005: ("I measured the rubber router yesterday and it was still fine...", False), 1006: ("", False), 1007: (None, False), 1008: (" \n ", False),
        1009: ("[deleted]", False), 1010: ("I measured the walnut saddle yesterday and it was still fine.", False), 1011: ("Does a walnut router really need 4 screws or is\n-- \nsomeone", True), 1012: ("unheard words here", False),
        1013: (corpus[0][1] + " My neighbour told me to repl", True), 1014: ("I measured the copper hinge yesterday. " * 3000, False),
    }
    got, out = flags(spark, corpus + [(k, t, None if k % 2 else "forum") for k, (t, _) in cases.items()])
    assert {k: got[k] for k in cases} == {k: v for k, (_, v) in cases.items()}
    assert not any(got[r[0]] for r in corpus) and len(out) == len(corpus) + len(cases)


def test_field_limit(spark, corpus):
    rng = random.Random(4)
    rows = []
    for i in range(30):
        text = ""
        while len(text) < 150:
            text += sentence(rng) + ". "
        rows.append((2000 + i, text[:150], "limited"))
    got, _ = flags(spark, corpus + rows)
    assert all(got[r[0]] for r in rows)


def test_prefix_of_a_longer_copy(spark):
    long = "Quite an unusual remark about nothing that anyone else would ever have written in this place at all"
    got, _ = flags(spark, [(1, long, "a"), (2, long[:80], "a"), (3, long, "b")])
    assert long[79].isalpha() and long[80].isalpha() and got == {1: False, 2: True, 3: False}


def test_empty(spark):
    assert flags(spark, []) == ({}, [])
    assert T.rates(T.truncated(spark.createDataFrame([], "doc_id long, text string, source string"))).count() == 0


def test_stump_of_many_texts(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abdegiklmnoprstu") for _ in range(7)) for _ in range(4000)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, f"{some(7)} zwonkerish {some(4)}.", "a") for i in range(60)] + [(100 + i, f"{some(9)} zwonk", "a") for i in range(5)] + [(200 + i, f"{some(5)} vull {some(3)} vullage {some(3)}.", "a") for i in range(60)] + [(300, f"{some(9)} vull", "a")]
    got, _ = flags(spark, rows)
    assert {k for k, cut in got.items() if cut} == {100, 101, 102, 103, 104}


def test_prefixes_of_every_kind(spark):
    long = "Quite an unusual remark about nothing that anyone else would ever have written in this place at all"
    other = "So" + long[2:]
    page = "Quite another remark about nothing that anyone would ever have read at veku-ma.invalid"
    cut = {2: long[:70], 3: other[:71], 4: long[:27] + "…", 5: long[:28]}
    kept = {6: long[:29].rpartition(" ")[0], 7: page, 8: long[:10]}
    docs = [(1, long), (10, other), (9, page + " today and more"), *cut.items(), *kept.items()]
    assert long[70] == " " and long[71] != " "
    got = {r["doc"] for r in T.prefixes(spark.createDataFrame([(i, x.rstrip("…")) for i, x in docs], "doc long, body string")).collect()}
    assert got == set(cut)


def test_hashes_of_arrays_are_those_of_windows():
    """Windows and sentences hashed from arrays equal those of single ends, at every word and width."""
    rng = random.Random(6)
    text = "- first item. " + " ".join(sentence(rng) + rng.choice([". ", "! ", "\n- ", ", "]) for _ in range(30)) + "and an open end"
    parts = T._SPLIT.split(text)
    tokens, gaps = parts[1::2], [*(T._GAP[g] for g in parts[2:-1:2]), 3]
    seq, after, begins, want, before = [], [], [], {}, []
    words = []
    for i, (t, g) in enumerate(zip(tokens, gaps)):
        if i == 0 or gaps[i - 1] in (1, 2):
            words = [T._ITEM if i == 0 or gaps[i - 1] == 2 else T._START]
            seq, after, begins = [*seq, words[0]], [*after, -1], [*begins, True]
        words.append(T._HASH[t])
        seq, after, begins = [*seq, words[-1]], [*after, -1 if g == 3 else min(g, 1)], [*begins, False]
        before.append(T._polynomial(words[-3:-1]))
        if g != 3:
            for h in [T._polynomial(words[-k:]) for k in T.WIDTHS if len(words) >= k] + [T._whole(words)] * (len(words) > T.WIDTHS[0]):
                want[h, min(g, 1)] = want.get((h, min(g, 1)), 0) + 1
    got_grams, got_kinds, got_before = T._windows(np.array(seq, np.uint64), np.array(after), np.array(begins))
    got = {}
    for k in zip(got_grams.tolist(), got_kinds.tolist()):
        got[k] = got.get(k, 0) + 1
    assert got == want and got_before[~np.array(begins)].tolist() == before and len(want) > 300


def test_planted_cuts(spark, corpus):
    """Of complete texts cut at random places inside a sentence nearly all are found, and none that was left whole."""
    rng = random.Random(8)
    rows = [(3000 + i, t[: rng.randrange(len(t) // 2, len(t) - 3)], "forum") for i, (_, t, _) in enumerate(corpus[:150])]
    rows = [r for r in rows if r[1][-1].isalnum() and corpus[r[0] - 3000][1][len(r[1])] not in ".!? "]
    got, out = flags(spark, corpus + rows)
    assert len(rows) > 80 and sum(got[r[0]] for r in rows) >= 0.95 * len(rows) and not any(got[r[0]] for r in corpus)
    assert "sentence" in {r["path"] for r in out if r["cut"]} and all((r["path"] is None) != r["cut"] for r in out)


def test_marks_and_last_lines():
    assert T._without(T._MARK, "x" * 300 + " " * 2000 + "(truncated)") == "x" * 300 and T._without(T._MARK, "a") == "a"
    assert T.last_sentence("One two. Three four") == (["Three", "four"], False) and T.last_sentence("One two.\n") == ([], False)
    assert T.last_sentence("One\n- two three") == (["two", "three"], True) and T.last_sentence("") == ([], False)
