import random

import pytest

from kinfold.llm import encode as E

TEXTS = ["", " ", "Hello world", "it's  <|endoftext|> 12345", "naïve café – ₹5 🦊👨‍👩‍👧", "a" * 30000, " \n\t x  ", "数字と日本語", "नमस्ते", None, "Hello world"]


def reference(text):
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=E._ranks(E.vocabulary_path()), special_tokens={}).encode_ordinary(text) if text else []


def test_ids_equal_the_tokenizer(spark):
    rng = random.Random(5)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randrange(32, 0x2FFF), rng.randrange(0x1F300, 0x1F9FF), 32, 10, 39, 0x85, 0xA0])) for _ in range(60)) for _ in range(200)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, word int").repartition(3)
    got = {r["doc_id"]: r["ids"] for r in E.encode(df).collect()}
    assert got == {i: reference(t) for i, t in enumerate(texts)}


def test_other_library_agrees():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as P

    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for x in TEXTS:
        if x is not None:
            assert t.encode(x, add_special_tokens=False).ids == [i for w in E.split_words(x) for i in E.encode_word(w, E.vocabulary_path())]


def test_round_trip(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in E.decode(E.encode(df)).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_repeated_and_null_ids_keep_their_rows(spark):
    df = spark.createDataFrame([(2**62 + 1, "a b"), (2**62 + 1, "a b"), (None, "c")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["ids"]) for r in E.encode(df).collect())
    assert got == sorted([(0, reference("c")), (2**62 + 1, reference("a b")), (2**62 + 1, reference("a b"))])


def test_counts_are_the_lengths_of_ids(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["tokens"] for r in E.count_tokens(df).collect()} == {i: len(reference(t)) for i, t in enumerate(TEXTS)}


def test_ascii_texts_are_split_alike():
    rng = random.Random(7)
    for _ in range(3000):
        x = "".join(chr(rng.choice([rng.randrange(128), 32, 32, 10, 39, 97, 115])) for _ in range(40))
        assert E.split_words(x) == E._splitter().findall(x)


def test_empty(spark):
    assert E.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
