"""Texts cut off before their end: ends that are strict prefixes of longer copies elsewhere.

A self-join by prefix, in three kinds of values. Each looks for copies in the whole corpus:

* the whole text: texts are put together by a hash of their first characters and sorted, where a text that is a strict
  prefix of any other is one of its successor;
* the last sentence as far as it goes, and the rests of it from six down to two words before the end: they are hashed, and
  so is the corpus at every word: every sentence from its start up to that word, and its last six to two words. So a hash
  says how often the same words are complete elsewhere and how often they are a strict prefix of a longer copy. The
  longest value with evidence decides: it is cut where copies go on and (nearly) none is complete;
* the last word: after the same words before it, or else anywhere, the corpus has words of which it is a strict prefix.

Hashes are made from arrays, a batch of texts at a time, and counted before they move; then they are joined, so nothing is
compared pairwise. A length at which one source has far more texts than at lengths near it, most of them with such ends,
is a limit of its field: texts of that length are cut too. A mark of omission at the end is read as a mark, not as text; a
signature after the cut does not hide it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.session import map_tables, materialize

_TOKEN = re.compile(r"(?:https?://|www\.)\S+|\w[\w-]*(?:\.[a-z][\w-]+)+(?:/\S*)?|\d[\d.,]*\d|\d|[^\W\d_]+(?:['’&;#\d]+[^\W\d_]+)*")
_STOP = re.compile(r"[.!?…。।？！\n]|<br|</|\[/")
_CLEAN = re.compile(r"[.!?。।？！]")
_MARK = re.compile(r"\s*(?:\(truncated\)|\[more\]|\[\.\.\.\]|\.{3,}|…)\s*$")
_HARD = re.compile(r"\s*(?:\(truncated\)|\[more\]|\[\.\.\.\])\s*$")
_CLOSE = re.compile(r"(?:\s|</\w+>|\[/\w+\]|\*\*|`+|&quot;|[\"”»)]|¯\\_\(ツ\)_/¯|:-?[)(/DP]|\^\^|\blol\b|\betc\b)+$")
_SIGNATURE = re.compile(r"\n(?:-- ?|_{5,})\n")
_STUB = re.compile(r"^\s*[\[(][^\])]{0,60}(?:deleted|removed)[^\])]{0,60}[\])]\s*$")
WIDTHS = (6, 4, 3, 2)
WHOLE = 7
#: Occurrences that are taken to be complete before any is counted, by width: the shorter the words, the more copies must
#: go on before that says something.
DOUBT = {WHOLE: 0.4, 6: 0.4, 4: 0.68, 3: 1.09, 2: 1.36}
#: Share of the copies of an end that may be complete (other cut texts, careless ends) while it is still a strict prefix.
COMPLETE = 0.12
HEAD = 64
SHORT = 16
TOKENS = 1_500_000

_SPLIT = re.compile(f"({_TOKEN.pattern})")
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)
#: What stands for the start of a sentence, and of one in a list.
_START, _ITEM = (xxhash.xxh64_intdigest(x) for x in ("^", "^-"))


def _word(w: str) -> str:
    if w[0].isdigit():
        return "#"
    if "://" in w or w.startswith("www.") or "." in w:
        return "@"
    return w.lower()


class _Kept(dict):
    """A dictionary that makes its missing values; emptied when it has grown large."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key: str):
        if len(self) > 1_000_000:
            self.clear()
        value = self[key] = self.make(key)
        return value


#: Token -> hash of the word it is.
_HASH = _Kept(lambda w: xxhash.xxh64_intdigest(_word(w).encode("utf-8", "surrogatepass")))
#: Text between two words -> 0 the sentence goes on, 1 it ends, 2 it ends and an item of a list follows.
_GAP = _Kept(lambda g: (2 if g.endswith("\n- ") else 1) if _STOP.search(g) else 0)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _polynomial(words: list[int]) -> int:
    """Hash of a window: its last word counts once, the one before it times P, and so on."""
    h = 0
    for w in words:
        h = (h * _P + w) & _MASK
    return h


def _whole(words: list[int]) -> int:
    """Hash of a sentence from its start, in the order that prefixes of it can be summed up in."""
    h = 0
    for w in reversed(words):
        h = (h * _P + w) & _MASK
    return h ^ 1


def _without(mark: re.Pattern, text: str) -> str:
    """``text`` without ``mark`` (a pattern of ends of texts), looking from the end only as far as needed."""
    size = 256
    while True:
        tail = text[-size:]
        m = mark.search(tail)
        if m is None:
            return text
        if m.start() or len(tail) == len(text):
            return text[: len(text) - len(tail) + m.start()]
        size *= 4


def last_sentence(text: str) -> tuple[list[str], bool]:
    """Words of the last sentence of a text and whether it is an item of a list; no words where the text ends it.

    A line break ends a sentence, so only the last line with a word is taken apart.
    """
    line = text.rstrip("\n")
    line = line[line.rfind("\n") + 1 :]
    parts = _SPLIT.split(line)
    tokens, gaps = parts[1::2], parts[2::2]
    if not tokens:
        if len(line) < len(text.rstrip("\n")):
            return last_sentence(text[: len(text.rstrip("\n")) - len(line)]) if not _CLEAN.search(line) else ([], False)
        return [], False
    if _CLEAN.search(gaps[-1]):
        return [], False
    first = max((i + 1 for i, g in enumerate(gaps[:-1]) if _GAP[g]), default=0)
    return tokens[first:], not first and parts[0].endswith("- ") and len(parts[0]) == 2


def ends(body: str) -> list[tuple[list[str], bool]]:
    """Last sentences to be judged: of the text, and of what stands before a signature."""
    out = []
    for part in (body, *([body[: s.start()]] if (s := _SIGNATURE.search(body)) else [])):
        if part is not body and part[part.rfind("\n") + 1 :].startswith((">", "- ")):
            continue
        words, item = last_sentence(_without(_CLOSE, part))
        if words and not (len(words) == 1 and words[0][0].isdigit() and not item):
            out.append((words, item))
    return out


def tails(docs: DataFrame) -> DataFrame:
    """Ends with no sentence mark of ``doc, body``: ``doc, no, width, gram, before, last``, a row for each width it has; width
    0 asks for longer last words."""
    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            rows = []
            for doc, body in zip(batch["doc"], batch["body"]):
                for no, (tokens, item) in enumerate(ends(body)):
                    words = [_ITEM if item else _START, *(_HASH[t] for t in tokens)]
                    rows += [(doc, no, k, _signed(_polynomial(words[-k:])), None, None) for k in WIDTHS if len(words) >= k]
                    if len(words) > WIDTHS[0]:
                        rows.append((doc, no, WHOLE, _signed(_whole(words)), None, None))
                    rows.append((doc, no, 0, None, _signed(_polynomial(words[-3:-1])), _word(tokens[-1])))
            names = ("doc", "no", "width", "gram", "before", "last")
            yield dict(zip(names, map(list, zip(*rows) if rows else ((),) * 6)))

    return map_tables(docs.select("doc", "body"), run, "doc long, no int, width int, gram long, before long, last string")


def _windows(words: np.ndarray, after: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows that end at a word with ``after`` 0 (goes on) or 1 (ends), and of the two words before each.

    ``begins`` marks the starts of sentences, which are words of their own (``after`` -1) and part of windows.
    """
    n = len(words)
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(begins, at, 0))
    reach = at - start  # words before this one in its sentence, its start included
    p, grams, kinds = np.uint64(_P), [], []
    counts = (after >= 0) & ~begins
    window = words.copy()
    for k in range(2, WIDTHS[0] + 1):
        shifted = np.zeros(n, np.uint64)
        shifted[k - 1 :] = words[: n - k + 1]
        window = window + shifted * np.uint64(pow(_P, k - 1, 1 << 64))
        if k in WIDTHS:
            some = counts & (reach >= k - 1)
            grams.append(window[some])
            kinds.append(after[some])
    powers = np.full(n, p)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    total = np.add.accumulate(words * powers)
    back = np.full(n, np.uint64(_INVERSE))
    back[0] = 1
    back = np.multiply.accumulate(back)
    upto = np.where(start > 0, total[start - 1], np.uint64(0))
    long = counts & (reach >= WIDTHS[0])
    grams.append((((total - upto) * back[start]) ^ np.uint64(1))[long])
    kinds.append(after[long])
    one = np.zeros(n, np.uint64)
    one[1:] = words[:-1]
    two = np.zeros(n, np.uint64)
    two[2:] = words[:-2]
    before = np.where(reach >= 2, one + two * p, one)
    return np.concatenate(grams), np.concatenate(kinds), before


def windows(docs: DataFrame) -> DataFrame:
    """Hashed values of all texts (``doc, body``), counted within some texts before they move: ``gram, ended, goes_on`` and
    ``before, word, n``."""
    def counted(words: list[int], gaps: list[int], firsts: list[int], items: list[bool], names: list[str]) -> Iterator[dict]:
        # Starts of sentences are put in front of their first words.
        w, g = np.array(words, np.uint64), np.array(gaps, np.int8)
        begin = np.zeros(len(w), bool)
        begin[1:] = (g[:-1] == 1) | (g[:-1] == 2)
        begin[firsts] = True
        item = np.zeros(len(w), bool)
        item[1:] = g[:-1] == 2
        item[firsts] = items
        where = np.flatnonzero(begin)
        mark = np.where(item[where], np.uint64(_ITEM), np.uint64(_START))
        seq, after = np.insert(w, where, mark), np.insert(np.where(g == 3, -1, np.minimum(g, 1)), where, -1)
        starts = np.zeros(len(seq), bool)
        starts[where + np.arange(len(where))] = True
        grams, kinds, before = _windows(seq, after, starts)
        order = np.argsort(grams)
        grams, kinds = grams[order], kinds[order]
        edge = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.array([], int)
        ended = np.add.reduceat(kinds, edge, dtype=np.int64) if len(edge) else edge
        size = np.diff(np.r_[edge, len(grams)])
        none = np.zeros(len(edge), bool)
        yield {"gram": (grams[edge].view(np.int64), None), "ended": (ended, None), "goes_on": (size - ended, None), "before": (np.zeros(len(edge), np.int64), ~none), "word": ([None] * len(edge), None), "n": (np.zeros(len(edge), np.int64), None)}
        code: dict[str, int] = {}
        ids = np.array([code.setdefault(x, len(code)) for x in names], np.int64)
        pairs = np.empty(len(ids), dtype=[("before", np.int64), ("word", np.int64)])
        pairs["before"], pairs["word"] = before[~starts].view(np.int64), ids
        got, n = np.unique(pairs, return_counts=True)
        listed = list(code)
        void = np.ones(len(got), bool)
        yield {"gram": (np.zeros(len(got), np.int64), void), "ended": (np.zeros(len(got), np.int64), None), "goes_on": (np.zeros(len(got), np.int64), None), "before": (got["before"].copy(), None), "word": ([listed[i] for i in got["word"].tolist()], None), "n": (n, None)}

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict]:
        named = _Kept(_word)
        empty = lambda: ([], [], [], [], [])
        words, gaps, firsts, items, names = empty()
        for batch in batches:
            for body in batch["body"]:
                parts = _SPLIT.split(body)
                tokens = parts[1::2]
                if not tokens:
                    continue
                firsts.append(len(words))
                items.append(parts[0].endswith("- "))
                words.extend(map(_HASH.__getitem__, tokens))
                names.extend(map(named.__getitem__, tokens))
                gaps.extend(map(_GAP.__getitem__, parts[2:-1:2]))
                gaps.append(1 if _CLEAN.search(parts[-1]) else 3)
                if len(words) >= TOKENS:
                    yield from counted(words, gaps, firsts, items, names)
                    words, gaps, firsts, items, names = empty()
        if words:
            yield from counted(words, gaps, firsts, items, names)

    return map_tables(docs.select("body"), run, "gram long, ended long, goes_on long, before long, word string, n long")


def judged(docs: DataFrame) -> DataFrame:
    """``doc, cut, path`` of texts (``doc, body``) with an end whose longest value with evidence, or else whose last word,
    goes on elsewhere (true) or not (false); texts without evidence have no row. ``path`` says which value decided."""
    ends_ = materialize(tails(docs), "ends")
    seen = materialize(windows(docs), "windows")
    asked = ends_.filter("width > 0")
    grams = seen.filter(F.col("gram").isNotNull()).join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.sum("ended").alias("ended"), F.sum("goes_on").alias("goes_on"))
    # A value says something when enough copies are known beside the doubt of its width; the longest one that does decides.
    doubt = F.create_map(*[F.lit(x) for kv in DOUBT.items() for x in kv])[F.col("width")]
    copies = F.col("ended") + F.col("goes_on")
    by_window = (
        asked.join(grams, "gram").filter(COMPLETE * copies >= (1 - COMPLETE) * doubt)
        .groupBy("doc", "no").agg(F.max(F.struct("width", (F.col("ended") < COMPLETE * copies).alias("cut"))).alias("m"))
        .select("doc", "no", F.col("m.cut").alias("cut"), F.col("m.width").alias("width"))
    )
    last = ends_.filter("width = 0").select("doc", "no", "before", "last")
    pairs = last.select("before", "last").distinct()
    # A text's own last word is no evidence that the corpus has it: stumps would count for themselves. A sentence of under
    # five words, such as a sign-off, is evidence of its name; only the one asked about is left out after the same words.
    minus = lambda df: df.select("before", F.col("last").alias("word"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("own"))
    long = asked.filter("width = 6").select("doc", "no")
    own_signed = minus(last.join(long, ["doc", "no"], "left_anti").select("before", "last").distinct())
    followed = seen.filter(F.col("before").isNotNull()).select("before", "word", "n", F.col("n").alias("own")).unionByName(minus(last.join(long, ["doc", "no"], "left_semi")))
    counts = F.sum("n").alias("n"), F.greatest(F.sum("own"), F.lit(0)).alias("own")
    after = followed.unionByName(own_signed).join(last.select("before").distinct(), "before", "left_semi").groupBy("before", "word").agg(*counts)
    # Words meet ends by their beginnings: linear in the words after a context, however many ends ask for it.
    heads = lambda c, least: F.transform(F.sequence(F.lit(least), F.length(c) - 1), lambda i: F.left(c, i))
    begun = after.filter(F.length("word") > 1).select("before", F.explode(heads(F.col("word"), 1)).alias("last"), F.col("n").alias("longer"), F.lit(0).alias("same"))
    whole = after.select("before", F.col("word").alias("last"), F.lit(0).alias("longer"), F.col("own").alias("same"))
    longer = (
        begun.unionByName(whole).join(pairs, ["before", "last"], "left_semi").groupBy("before", "last").agg(F.sum("longer").alias("longer"), F.sum("same").alias("same"))
        .filter("longer >= 2 AND longer >= 5 * same").select("before", "last", F.lit(True).alias("part"))
    )
    # A last word that the corpus hardly has, but many times as the start of longer ones, whatever stands before it.
    vocabulary = followed.groupBy("word").agg(*counts)
    wanted = last.filter(F.length("last") >= 2).select("last").distinct()
    starts = vocabulary.filter(F.length("word") > 2).select(F.explode(heads(F.col("word"), 2)).alias("last"), "n")
    starts = starts.join(wanted, "last", "left_semi").groupBy("last").agg(F.sum("n").alias("starts"))
    own = vocabulary.select(F.col("word").alias("last"), "own")
    stump = starts.filter("starts >= 20").join(own, "last", "left").filter("20 * coalesce(own, 0) <= starts").select("last", F.lit(True).alias("stump"))
    verdict = last.join(by_window, ["doc", "no"], "left").join(longer, ["before", "last"], "left").join(stump, "last", "left")
    path = F.when(F.col("width") == WHOLE, "sentence").when(F.col("width").isNotNull(), F.concat(F.lit("last "), "width", F.lit(" words"))).otherwise("last word")
    found = verdict.withColumn("cut", F.coalesce("cut", "part", "stump")).filter(F.col("cut").isNotNull())
    return found.groupBy("doc").agg(F.max(F.struct("cut", path.alias("path"))).alias("m")).select("doc", "m.cut", "m.path")


def prefixes(docs: DataFrame) -> DataFrame:
    """``doc``: texts (``doc, body``, marks of omission taken off) that are strict prefixes of another text.

    They end in the middle of a word, or between two words of a sentence that the other goes on with. Texts of 16 to 63
    characters, which often are whole sentences that others go on from, count in the middle of a word only; shorter
    ones are prefixes by chance.
    """
    texts = docs.select("doc", "body").filter(F.length("body") >= SHORT)

    def heads(pool: DataFrame, n: int) -> DataFrame:
        w = W.partitionBy(F.xxhash64(F.left("body", F.lit(n)))).orderBy("body")
        pre = pool.distinct().withColumn("next", F.lead("body").over(w)).filter(F.startswith("next", F.col("body")))
        return pre.withColumns({"in_word": F.substring("next", F.length("body"), F.lit(2)).rlike(r"^\p{L}\p{L}$"), "on": F.substring("next", F.length("body") + 1, F.lit(2))})

    # Not after an address of a page, which texts end with.
    between = F.col("body").rlike(r"(^|\s)[\p{L}\p{N}'’]+[,;]? ?$") & (F.col("body").rlike(r"[\p{L}\p{N},;] $") & F.col("on").rlike(r"^[\p{Ll}\p{N}]") | F.col("body").rlike(r"[\p{L}\p{N},;]$") & F.col("on").rlike(r"^ [\p{Ll}\p{N}]$"))
    long = heads(texts.filter(F.length("body") >= HEAD).select("body"), HEAD).filter(F.col("in_word") | between).select("body")
    # Only the beginnings of texts that begin as a short one does are sorted with it.
    begin = texts.withColumn("head", F.left("body", F.lit(SHORT)))
    asked = begin.filter(F.length("body") < HEAD).select("head").distinct()
    pool = begin.join(asked, "head", "left_semi").select(F.left("body", F.lit(HEAD + 2)).alias("body"))
    short = heads(pool, SHORT).filter(F.length("body") < HEAD).filter("in_word").select("body")
    return texts.join(long.unionByName(short), "body", "left_semi").select("doc")


def truncated(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, cut, path`` for every row; ``cut`` is true for a text that was cut off, ``path`` says what showed it.

    Null, empty and blank texts and stubs of deleted posts are not cut. A null source is a source of its own. Ids are
    taken to be unique; texts are read whole; other columns are ignored.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(source).alias("source"), F.col(text).alias("text"))
    live = rows.filter(F.trim("text") != "").filter(~F.col("text").rlike(_STUB.pattern))
    # Texts without a mark of omission are the most; the pattern that takes one off is asked for the others only.
    end = F.rtrim(F.right("text", F.lit(40)))
    marked = F.endswith(end, F.lit("...")) | F.endswith(end, F.lit("…")) | F.endswith(end, F.lit("]")) | F.endswith(end, F.lit(")")) | (end == "") | end.rlike(r"\s$")
    body = F.when(marked, F.regexp_replace("text", r"\s*(\(truncated\)|\[more\]|\[\.\.\.\]|\.{3,}|…)\s*$", "")).otherwise(F.col("text"))
    live = materialize(live.select("doc", "source", body.alias("body"), F.xxhash64("text").alias("h"), (marked & F.col("text").rlike(_HARD.pattern)).alias("hard")), "texts")
    verdicts = judged(live.select("doc", "body"))
    copies = prefixes(live).distinct().withColumn("copy", F.lit(True))
    # An end that is known to be complete elsewhere is complete, also where another text happens to go on.
    how = F.when(F.col("copy"), "whole text").otherwise(F.col("path"))
    found = materialize(verdicts.join(copies, "doc", "full").filter(F.coalesce("cut", "copy")).select("doc", how.alias("path")), "ends_found")
    sized = live.select("doc", "source", F.length("body").alias("len"), "h", "hard")
    marked = sized.join(found, "doc", "left").withColumn("path", F.coalesce("path", F.when(F.col("hard"), "mark of omission")))
    # Repeated texts count once towards a length.
    per = marked.groupBy("source", "len", "h").agg(F.count("path").alias("found")).groupBy("source", "len").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("found") > 0).alias("cut"))
    near = W.partitionBy("source").orderBy("len").rangeBetween(-30, 30)
    usual = (F.sum("n").over(near) - F.col("n")) / 60
    limits = per.withColumn("usual", usual).filter("n >= 5 AND n >= 4 * usual AND cut >= 0.5 * n").select(F.col("source").alias("s_"), F.col("len").alias("l_"), F.lit("length limit").alias("at_limit"))
    out = marked.join(limits, F.col("source").eqNullSafe(F.col("s_")) & (F.col("len") == F.col("l_")), "left")
    cut = out.select("doc", F.coalesce("path", "at_limit").alias("path")).filter(F.col("path").isNotNull())
    flags = rows.select("doc", "source").join(cut.groupBy("doc").agg(F.min("path").alias("path")), "doc", "left")
    return flags.select(F.col("doc").alias(id_column), F.col("source").alias(source), F.col("path").isNotNull().alias("cut"), "path")


def rates(flags: DataFrame, source: str = "source") -> DataFrame:
    """``source, n_docs, n_cut, rate`` of flagged texts."""
    return flags.groupBy(source).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("cut").alias("n_cut")).withColumn("rate", F.col("n_cut") / F.col("n_docs"))
