"""Variant spellings of organisation names: canonical rewritings, exploded and equi-joined, scored by their rarity.

A name is read as brand, given name, own words, kin word, line of business and legal form. Rules rewrite each part to a
canonical one: sound and look-alike spellings, abbreviations, pet forms, initials, legal forms, places in brackets, token
order, joined and divided words. What is left is a *form*: the identity of the name apart from its own words, and the
own words as one string. Names with the same form are variants. Own words with typing errors are rewritten by leaving out
one letter each (a deletion neighbourhood); an equi-join on those finds forms one edit or transposition apart.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm import lexicon as X
from kinfold.llm.graph import much_rarer, roots, usual
from kinfold.session import map_columns, materialize, spread

_DIGITS = str.maketrans("013456789", "oieasbtbg")


@lru_cache(maxsize=400_000)
def plain(word: str) -> str:
    """Without accents, and digits inside words as the letters they look like."""
    if word.isascii() and word.isalpha():
        return word
    if not word.isascii():
        word = unicodedata.normalize("NFKD", word.replace("ß", "ss")).encode("ascii", "ignore").decode()
    return word.translate(_DIGITS) if any(c.isalpha() for c in word) else word


#: Fixed values, in order of use.
_SOUNDS = (("ght", "t"), ("tch", "ch"), ("sch", "sh"), ("ph", "f"), ("kh", "k"), ("ck", "k"), ("ee", "i"), ("oo", "u"), ("ch", "C"))
_LIKE = str.maketrans({"c": "k", "q": "k", "w": "v", "y": "i", "l": "i", "g": "j", "m": "rn"})
_DOUBLED = re.compile(r"(.)\1+")


@lru_cache(maxsize=400_000)
def skeleton(word: str) -> str:
    """A spelling that sounds and looks alike share: one letter for each group of exchangeable ones, none doubled."""
    w = plain(word)
    for a, b in _SOUNDS:
        if a in w:
            w = w.replace(a, b)
    w = _DOUBLED.sub(r"\1", w.translate(_LIKE).replace("ks", "x").replace("th", "t"))
    return w[:-1] if len(w) > 4 and w.endswith("e") else w


def edits(a: str, b: str, most: int = 2) -> int:
    """Edits with transpositions (optimal alignment), ``most + 1`` when there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    # What both begin or end with takes no edit.
    n = min(len(a), len(b))
    start = next((i for i in range(n) if a[i] != b[i]), n)
    end = next((i for i in range(n - start) if a[-1 - i] != b[-1 - i]), n - start)
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def _vocabulary() -> dict[str, tuple[str, str]]:
    """Word -> (class, canonical word)."""
    out: dict[str, tuple[str, str]] = {}
    for kind, words in (("line", X.LINES), ("second", X.SECONDS), ("kin", X.KIN), ("brand", X.BRANDS), ("legal", X.LEGAL)):
        for w in words:
            out[w] = (kind, w)
    out["coffeehouse"] = ("line", "coffee")
    for w in ("express", "house", "station", "mobile", "club", "bank", "mother", "hotels", "coffee", "kitchen", "store", "farm", "shoes", "sweets"):
        out.setdefault(w, ("line", w))
    for full, short in X.ABBREVIATIONS.items():
        for s in short.split():
            out.setdefault(s, out[full])
    for full, short in X.NICKNAMES.items():
        out[full] = ("given", full)
        for s in short.split():
            out.setdefault(s, ("given", full))
    return out


VOCABULARY = _vocabulary()
#: Words long enough to be recognised when mistyped, by skeleton and by first and last letters.
_LONG = {w: v for w, v in VOCABULARY.items() if len(w) >= 5 and (v[0] != "line" or w in X.LINES or len(w) >= 7) or len(w) == 4 and w == v[1] and v[0] != "given"}
_BY_SKELETON = {skeleton(w): v for w, v in reversed(_LONG.items()) if len(skeleton(w)) >= 3}


def _cuts(word: str) -> set[str]:
    return {word, *[word[:i] + word[i + 1 :] for i in range(len(word))]}


_BY_CUT: dict[str, set[str]] = {}
for _w in _LONG:
    for _x in _cuts(_w):
        _BY_CUT.setdefault(_x, set()).add(_w)


def _letters(word: str) -> int:
    """The letters that occur, and those that occur more than once, as bits."""
    once = more = 0
    for c in word:
        bit = 1 << (ord(c) & 31)
        more |= once & bit
        once |= bit
    return once | more << 32


#: By length, letters and word of those long enough to be recognised with two edits, and how many bits these change: an
#: exchange two, a letter more or less one.
_SETS: dict[int, list[tuple[int, int, str]]] = {}
for _w in _LONG:
    if len(_w) >= 7:
        for _n in range(len(_w) - 2, len(_w) + 3):
            _SETS.setdefault(_n, []).append((_letters(_w), 4 - abs(len(_w) - _n), _w))


@lru_cache(maxsize=400_000)
def known(word: str) -> tuple[str, str] | None:
    """Class and canonical word of a vocabulary word, also mistyped by one edit or spelt as it sounds."""
    if word in VOCABULARY:
        return VOCABULARY[word]
    w = plain(word)
    if w.startswith("and") and len(w) > 6:  # "and daughters" in one word
        rest = known(w[3:])
        if rest and rest[0] == "kin":
            return rest
    if w in VOCABULARY:
        return VOCABULARY[w]
    if len(w) < 4:
        return None
    if (s := skeleton(w)) in _BY_SKELETON:
        return _BY_SKELETON[s]
    near = {x for c in _BY_CUT.keys() & _cuts(w) for x in _BY_CUT[c] if edits(w, x, 1) == 1}
    if not near and len(w) >= 7:
        bits = _letters(w)
        near = {x for b, most, x in _SETS.get(len(w), ()) if (b ^ bits).bit_count() <= most and edits(w, x) == 2}
    return VOCABULARY[min(near)] if near else None


def _shortens(word: str, last: bool) -> bool:
    """Whether a word is the first and some further letters of a second or legal word, or the last word cut off."""
    if len(word) < 3 and not last:
        return False
    for x in (*X.SECONDS, *X.LEGAL):
        if last and x.startswith(word):
            return True
        if len(word) <= 6 and word[0] == x[0] and len(word) < len(x):
            letters = iter(x)
            if all(c in letters for c in word):
                return True
    return False


_FIRM = re.compile(r"(?:^| )(?:m s )+(?=[a-z]{2})")
_LETTERS = re.compile(r"\b(?:l l c|l l p|g m b h|m b h|p l c|k g|a g)\b")


def read(name: str) -> tuple[str, str, str, tuple[str, ...]] | None:
    """(line of business and kin, brand, given name or initial, own words); None for no name.

    Own words keep their order. A word that is only a town after the legal form or the line is left out.
    """
    if name in X.PLACEHOLDERS:
        return None
    words = name.split()
    if any(len(w) == 1 for w in words):
        words = _LETTERS.sub(lambda m: m[0].replace(" ", ""), _FIRM.sub(" ", name)).split()
    if len(words) > 1 and words[0] == "the":
        words = words[1:]
    brand = given = line = kin = ""
    own: list[str] = []
    seconds: list[str] = []
    legal = False
    n = len(words)
    for i, w in enumerate(words):
        k = known(w)
        kind, word = k if k else ("", "")
        if kind == "brand" and not brand and not own:
            brand = word
        elif kind == "given" and not given and (len(w) > 2 or n > 2):
            given = word
        elif kind == "line" and not line:
            line = word
        elif kind == "line":
            seconds.append(word)
        elif kind == "kin" and not kin:
            kin = word
        elif kind == "legal":
            legal = True
        elif kind == "second":
            seconds.append(word)
        elif plain(w) in ("and", "n", "of", "an", "andd", "adn", "ad", "amd", "anf", "snd", "the", "s") or w in ("p", "l") and (line or legal):
            pass
        elif (own or given) and (line or legal or seconds) and (_town(words, i) or _shortens(plain(w), i == n - 1)):
            pass
        else:
            own.append(w)
    if not line and len(own) > 1 and len(own[-1]) >= 3:  # a line of business cut off
        cut = [x for x in X.LINES if x.startswith(own[-1])]
        if len(cut) == 1:
            line = cut[0]
            own.pop()
    if not line and seconds:
        line = seconds[0]
    if not given and len(own) > 1 and len(own[0]) == 1:
        given, own = own[0], own[1:]
    if not given and own and len(own) > 1 and len(own[-1]) == 1:
        given, own = own[-1], own[:-1]
    return " ".join((line, kin)).strip(), brand, given, tuple(own)


def _town(words: list[str], i: int) -> bool:
    w = words[i]
    if any(c.isdigit() for c in w):
        return False
    return len(w) > 5 and w.endswith(X.TOWN_ENDS) or w in X.TOWN_SECONDS or i + 1 < len(words) and words[i + 1] in X.TOWN_SECONDS


def forms(name: str) -> list[tuple[str, str, str, str]]:
    """Canonical forms (context, brand, given, own) of a name: one for each order of up to three own words; of more, as
    written and in alphabetical order."""
    r = read(name)
    if r is None:
        return []
    context, brand, given, own = r
    givens = ("edward", "theodore") if "ted" in name.split() and given == "edward" else (given,)
    # Words are joined before they are spelt alike, as a name written in one word is.
    words = [w[:-1] if len(w) > 4 and w.endswith("e") else w for w in own]
    joined = {"".join(words)}
    if len(words) == 2:
        joined.add(words[1] + words[0])
    elif len(words) == 3:
        a, b, c = words
        joined |= {a + c + b, b + a + c, b + c + a, c + a + b, c + b + a}
    elif len(words) > 3:
        joined.add("".join(sorted(words)))
    return [(context, brand, g, j) for g in givens for j in sorted({skeleton(j) for j in joined})]


FORM = ["context", "brand", "givens", "forms"]


def rewritings(names: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """``keys, n, node, context, brand, givens, forms``: the canonical rewritings of distinct names (columns ``name, n``).

    ``keys`` are the columns that identify a name: itself, or signatures in its place. Several given names or forms are
    joined by bars; ``node`` identifies the whole. Null and empty names, placeholders and names without any word of their
    own have no row.
    """
    def run(batch: dict[str, list]) -> dict[str, list]:
        rows = []
        for name, *own in zip(batch["name"], *(batch[k] for k in keys), batch["n"]):
            f = forms(name) if name else []
            if f and (f[0][2] or f[0][3]):
                one = len(f) == 1
                rows.append((*own, f[0][0], f[0][1], f[0][2] if one else "|".join(sorted({x[2] for x in f})), f[0][3] if one else "|".join(sorted({x[3] for x in f}))))
        columns = (*keys, "n", *FORM)
        return dict(zip(columns, map(list, zip(*rows) if rows else ((),) * len(columns))))

    given = names.select(*dict.fromkeys(["name", *keys]), F.col("n").cast("long"))
    schema = ", ".join(f"{k} {given.schema[k].dataType.simpleString()}" for k in keys) + ", n long, context string, brand string, givens string, forms string"
    return map_columns(given, run, schema).withColumn("node", F.xxhash64(*FORM))


def _without(text: Column) -> Column:
    """The text, and the text with one letter left out at each place."""
    n = F.length(text)
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i == 0, text).otherwise(F.concat(F.left(text, i - 1), F.right(text, n - i))))


def _rests(ends: DataFrame) -> DataFrame:
    """``node, k`` of the rows ``node, k, rest``: texts within two edits of each other share one that is left of both when
    two letters at most are left out. Of long ones, that would be too many; they all meet.
    """
    n = F.length("rest")
    left = F.array_distinct(F.flatten(F.transform(_without(F.col("rest")), _without)))
    short = ends.filter(n <= LONG + 3).select("node", "k", F.explode(left).alias("left")).select("node", F.xxhash64("k", "left").alias("k"))
    return short.unionByName(ends.filter(n >= LONG).select("node", F.xxhash64("k", F.lit(">")).alias("k")))


#: How many rows a key of six letters may have before the rest of the form becomes part of it, and how long a rest counts
#: as long. No result depends on either.
CROWD, LONG = 64, 24


def _meetings(own: DataFrame) -> DataFrame:
    """``a, b``: ids of all nodes that share a key, of rows ``node, about, form``.

    Keys are the form, the form with each letter left out, and its first and last six letters. Few forms differ by one
    letter, but six letters can begin any number of forms. Where they do, the pairs that are not within two edits are
    never made: the rests of the forms become part of the key (``_rests``).
    """
    # Which key a row is for is a number, so that keys are made in compiled code: 0 is the form, i > 0 leaves letter i out,
    # -1 and -2 are its first and last six letters. Only numbers travel to the keys; the pairs that come back fetch forms.
    n, i = F.length("form"), F.col("i")
    which = own.withColumn("i", F.explode(F.sequence(F.when(n >= 8, -2).otherwise(0), F.when(n >= 3, n).otherwise(0))))
    left_out = F.concat(F.substring(F.col("form"), F.lit(1), i - 1), F.substring(F.col("form"), i + 1, F.lit(1000000)))
    key = F.when(i > 0, left_out).when(i == 0, F.col("form")).when(i == -1, F.concat(F.lit("<"), F.left("form", F.lit(6)))).otherwise(F.concat(F.lit(">"), F.right("form", F.lit(6))))
    met = which.select("node", F.xxhash64("about", key).alias("k"), (i < 0).alias("end"))
    w = W.partitionBy("k")
    # Most keys are of one node.
    met = met.select("*", F.min("node").over(w).alias("lo"), F.max("node").over(w).alias("hi"), F.count(F.lit(1)).over(w).alias("rows")).filter("lo <> hi")
    met = materialize(met.select("node", "k", (F.col("end") & (F.col("rows") > CROWD)).alias("crowd")), "meetings")
    few, crowds = met.filter("NOT crowd").select("node", "k"), met.filter("crowd").select("node", "k").distinct()
    if not crowds.isEmpty():
        # Forms come to the rows of crowded keys; all keys of all forms are far more rows, and Spark sizes those as the forms alone.
        part = lambda mark, head, rest: F.struct(F.xxhash64("about", F.concat(F.lit(mark), head)).alias("k"), rest.alias("rest"))
        f, all_ = F.col("form"), F.lit(1000000)
        sides = F.array(part("<", F.left(f, F.lit(6)), F.substring(f, F.lit(7), all_)), part(">", F.right(f, F.lit(6)), F.left(f, n - 6)))
        ends = spread(crowds).join(own.filter(n >= 8).select("node", F.inline(sides)), ["node", "k"])
        few = few.unionByName(_rests(ends.select("node", "k", "rest")))
    x, y = few.alias("x"), spread(few).alias("y")
    return x.join(y, F.expr("x.k = y.k AND x.node < y.node")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def name_groups(names: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """``keys, node, context, forms, root``: distinct names (columns ``name, n``, and ``keys``) with their group of spellings.

    The forms of all names are exploded into keys - a form with one letter left out at each place, and its first and last
    six letters - together with context, brand and first letter of the given name. All forms that share a key meet, however
    many they are. A pair within one edit is a rewriting; within two it is one only for long forms of which one is rare,
    since a rare spelling close to a common one is an error, and two common ones are two names.
    """
    read_ = materialize(rewritings(names, keys), "rewritings")
    nodes = read_.groupBy("node", *FORM).agg(F.sum("n").alias("weight"))
    nodes = materialize(nodes.withColumns({c: F.split(c, r"\|") for c in ("givens", "forms")}), "forms")
    own = nodes.select("node", F.xxhash64("context", "brand").alias("about"), F.explode("givens").alias("given"), "forms").select("node", F.xxhash64("about", F.left("given", F.lit(1))).alias("about"), F.explode("forms").alias("form"))
    pairs = _meetings(own)
    side = lambda x: nodes.select(F.col("node").alias(x), F.struct("context", "brand", "weight", "givens", "forms").alias(f"{x}_"))
    pairs = pairs.join(spread(side("a")), "a").join(spread(side("b")), "b").filter("a_.context = b_.context AND a_.brand = b_.brand")
    rare = much_rarer(F.col("a_.weight"), F.col("b_.weight"), usual(nodes))

    def alike(f: Column, g: Column) -> Column:
        two, shorter = F.levenshtein(f, g, 2), F.least(F.length(f), F.length(g))
        swapped = (two == 2) & (F.sort_array(F.split(f, "")) == F.sort_array(F.split(g, "")))
        return (f == g) | (shorter >= 4) & ((two == 1) | swapped) | (two == 2) & (shorter >= 7) & F.col("rare")

    initial = lambda h, k: (h == k) | (F.length(h) == 1) & F.startswith(k, h) | (F.length(k) == 1) & F.startswith(h, k)
    pairs = pairs.filter(F.exists("a_.givens", lambda h: F.exists("b_.givens", lambda k: initial(h, k))))
    each = pairs.select("a", "b", rare.alias("rare"), F.explode("a_.forms").alias("f"), F.col("b_.forms").alias("gs")).select("a", "b", "rare", "f", F.explode("gs").alias("g"))
    edges = each.filter(alike(F.col("f"), F.col("g"))).select("a", "b")
    groups = roots(nodes.select(F.col("node").alias("id"), "weight"), edges)
    return read_.select(*keys, "node", "context", F.split("forms", r"\|").alias("forms")).join(spread(groups.select(F.col("id").alias("node"), "root")), "node")


def same_organisation(names: DataFrame, scored: bool = False) -> DataFrame:
    """Pairs ``name_a < name_b`` of different names of one organisation (columns ``name, n``; repeated names are summed).

    ``scored`` adds ``score`` in [0, 1], by the rarity of rewritings: of a shared canonical form, the fewer of all names
    are written to it the higher; of two forms that are near spellings, that of the commoner one, less the share that the
    rarer one has of both, since an error is rare beside what it was meant to be.
    """
    distinct = names.filter(F.col("name") != "").groupBy("name").agg(F.sum("n").alias("n"))
    g = materialize(name_groups(distinct).select("name", "node", "root"), "name_groups")
    if not scored:
        return g.select(F.col("name").alias("name_a"), "root").join(spread(g.select(F.col("name").alias("name_b"), "root")), "root").filter("name_a < name_b").select("name_a", "name_b")
    total = g.agg(F.count(F.lit(1)).alias("n")).scalar()
    sizes = g.groupBy("node").agg(F.count(F.lit(1)).alias("w"))
    g = materialize(g.join(spread(sizes), "node").withColumn("rarity", F.log(total / F.col("w")) / F.log(total + F.lit(1))), "name_groups")
    side = lambda x: g.select("root", F.col("name").alias(f"name_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("node", "w", "rarity")])
    pairs = side("a").join(spread(side("b")), "root").filter("name_a < name_b")
    other = F.least("rarity_a", "rarity_b") * (1 - F.least("w_a", "w_b") / (F.col("w_a") + F.col("w_b")))
    return pairs.select("name_a", "name_b", F.when(F.col("node_a") == F.col("node_b"), F.col("rarity_a")).otherwise(other).alias("score"))
