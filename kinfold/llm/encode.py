"""Token ids of a whole corpus by a public byte-level BPE: every distinct word is encoded once.

Texts are divided into words (pre-tokens) with positions. A chunk - some consecutive texts of a task, bounded in
characters - lists each of its distinct words once, and its texts as positions in that list. The words of all chunks meet
in one global shuffle; each distinct word is encoded once; the ids go back to the chunks that hold the word, and every
chunk puts its texts together again by position. So a frequent word costs a row for each chunk, not for each occurrence.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.session import map_columns, map_tables, materialize, ship

VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK_CHARS = 2_000_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def _encoder(path: str):
    """Encodes a text that is one word, whatever it holds."""
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=_ranks(path), special_tokens={})


@functools.cache
def _splitter():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


@functools.cache
def _ascii_splitter():
    """The pattern for texts of ASCII characters only, where its classes are a few ranges, for the faster engine."""
    import public_tokenizers

    space = r"\t\n\x0b\x0c\r "
    ranges = ((r"[^\s\p{L}\p{N}]", f"[^{space}A-Za-z0-9]"), (r"\p{L}", "[A-Za-z]"), (r"\p{N}", "[0-9]"), (r"\s", f"[{space}]"), (r"\S", f"[^{space}]"))
    pattern = public_tokenizers.PATTERN
    for a, b in ranges:
        pattern = pattern.replace(a, b)
    return re.compile(pattern)


def split_words(text: str) -> list[str]:
    return (_ascii_splitter() if text.isascii() else _splitter()).findall(text)


def encode_word(word: str, path: str) -> list[int]:
    return _encoder(path).encode_ordinary(word)


class _Index(dict):
    """Numbers its keys in order of their first use."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def chunks(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """Rows of two kinds: texts ``chunk, doc, at`` and words ``chunk, idx, word``. Written once, so both kinds agree."""
    from pyspark import TaskContext

    def listed(chunk: int, docs: list, texts: list[str | None]) -> dict:
        import pyarrow as pa

        index, flat, sizes = _Index(), [], []
        for x in texts:
            before = len(flat)
            if x:
                flat.extend(map(index.__getitem__, split_words(x)))
            sizes.append(len(flat) - before)
        n, m = len(texts), len(index)
        offsets = np.zeros(n + m + 1, np.int32)
        offsets[1 : n + 1] = np.cumsum(sizes)
        offsets[n + 1 :] = offsets[n]
        word = np.arange(n + m) >= n
        at = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), mask=pa.array(word))
        return {"chunk": (np.full(n + m, chunk, np.int64), None), "doc": [*docs, *[None] * m], "at": at, "idx": (np.arange(n + m, dtype=np.int32) - n, ~word), "word": [*[None] * n, *index]}

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        chunk = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, t in zip(batch["doc"], batch["text"]):
                ids.append(doc)
                texts.append(t)
                size += len(t) if t else 0
                if size >= CHUNK_CHARS:
                    yield listed(chunk, ids, texts)
                    chunk, ids, texts, size = chunk + 1, [], [], 0
        if texts:
            yield listed(chunk, ids, texts)

    source = docs.select(F.col(id_column).cast("string").alias("doc"), F.col(text).alias("text"))
    return materialize(map_tables(source, run, "chunk long, doc string, at array<int>, idx int, word string"), "chunks")


def _known(parts: DataFrame, path: str | None, ids: bool) -> tuple[DataFrame, DataFrame]:
    """Texts ``of, doc, at`` of chunks, and their words with the ids of each (or only how many, ``n``): every distinct word
    of the corpus is encoded once."""
    def encode_words(batch: dict[str, list]) -> dict[str, list]:
        own = path or vocabulary_path()  # the executor's own, where none is given
        found = [encode_word(w, own) for w in batch["word"]]
        return {"word": batch["word"], "ids" if ids else "n": found if ids else list(map(len, found))}

    value = "ids" if ids else "n"
    listed = parts.filter(F.col("word").isNotNull()).select("chunk", "idx", "word")
    encoded = map_columns(listed.select("word").distinct(), encode_words, f"word string, {value} " + ("array<int>" if ids else "int"))
    texts = parts.filter(F.col("word").isNull()).select(F.col("chunk").alias("of"), "doc", "at")
    return texts, listed.join(encoded, "word").select("chunk", "idx", value)


def _sizes(at) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a list column."""
    return np.asarray(at.value_lengths()), np.asarray(at.flatten())


def encode(docs: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids``: the token ids of every text without special tokens.

    Empty and null texts have the empty list. Strings that look like special tokens are ordinary text. Every input row
    has its row, also with a repeated or null id; a text is handled whole, however long; other columns are ignored.
    ``vocabulary`` is a path that all executors can read; by default each takes that of its own installed package.
    """
    texts, known = _known(chunks(docs, id_column, text), vocabulary, True)

    def assemble(left, right):
        """Gathers the ids of all texts of a chunk at once."""
        import pyarrow as pa

        at, ids = left["at"].combine_chunks(), right["ids"].combine_chunks()
        idx = np.asarray(right["idx"])
        n_of, flat = _sizes(ids)
        begin_of = np.cumsum(n_of) - n_of
        starts, lengths = np.zeros(len(idx), np.int64), np.zeros(len(idx), np.int64)
        starts[idx], lengths[idx] = begin_of, n_of
        words, where = _sizes(at)
        n = lengths[where]
        upto = np.cumsum(n)
        picked = flat[np.repeat(starts[where] - (upto - n), n) + np.arange(n.sum())]
        offsets = np.r_[0, upto][np.r_[0, np.cumsum(words)]].astype(np.int32)
        return pa.table({"doc": left["doc"], "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(picked, pa.int32()))})

    ship(docs.sparkSession)
    out = texts.groupBy("of").cogroup(known.groupBy("chunk")).applyInArrow(assemble, "doc string, ids array<int>")
    return out.select(F.col("doc").cast(docs.schema[id_column].dataType).alias(id_column), "ids")


def count_tokens(docs: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, tokens``: how many token ids every text has, as ``encode`` would give them; no ids are moved."""
    texts, known = _known(chunks(docs, id_column, text), vocabulary, False)

    def assemble(left, right):
        import pyarrow as pa

        lengths = np.zeros(right.num_rows, np.int64)
        lengths[np.asarray(right["idx"])] = np.asarray(right["n"])
        words, where = _sizes(left["at"].combine_chunks())
        upto = np.r_[0, np.cumsum(lengths[where])][np.r_[0, np.cumsum(words)]]
        return pa.table({"doc": left["doc"], "tokens": pa.array(np.diff(upto), pa.int64())})

    ship(docs.sparkSession)
    out = texts.groupBy("of").cogroup(known.groupBy("chunk")).applyInArrow(assemble, "doc string, tokens long")
    return out.select(F.col("doc").cast(docs.schema[id_column].dataType).alias(id_column), "tokens")


def token_bytes(spark: SparkSession, vocabulary: str | None = None) -> DataFrame:
    """``id, piece``: the bytes of each token, as hexadecimal digits. As many rows as the vocabulary has, whatever the data."""
    rows = [(i, b.hex()) for b, i in _ranks(vocabulary or vocabulary_path()).items()]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "piece"]), "id int, piece string")


def decode(encoded: DataFrame, id_column: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, text``: texts from token ids (unique ``doc_id``), by joining the token-byte table. No ids give ''."""
    table = token_bytes(encoded.sparkSession, vocabulary)
    each = encoded.select(id_column, F.posexplode_outer(ids).alias("pos", "id"))
    pieces = each.join(F.broadcast(table), "id", "left")
    whole = pieces.groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("piece", F.lit("")).alias("piece")))).alias("p"))
    return whole.select(id_column, F.decode(F.unhex(F.array_join("p.piece", "")), "UTF-8").alias("text"))
