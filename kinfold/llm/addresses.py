"""Postal addresses of the same building, written differently: keys of misspelt components and sorted neighbourhoods.

An address is read as house number, street, kind of street, town and postal code; unit, floor, shop, suffixes of the house
number, extensions of the code, regions and landmarks are left out. Distinct readings then meet under keys that spellings close to each
other share, or sorted in two component orders, and are compared: street and town by edits and transpositions, house number and kind of
street strictly.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm import lexicon as X
from kinfold.llm.graph import much_rarer, near, roots, usual
from kinfold.llm.names import plain, skeleton
from kinfold.session import map_columns, materialize, spread

_KIND = {w: k for k, short in X.STREETS.items() for w in (k, *short.split())}
_LANDMARK = re.compile(r"\b(?:opposite|opp|near|nr|next to|behind|beside(?: the)?|above(?: the)?) (?:town hall|bus stand|water tank|railway gate|clock tower|old mill|fish market|bakery)\b")
_UNIT = re.compile(r"\b(?:unit|apt|suite|ste|shop no|shop|flr|floor|flat|office|room) (?:no )?\w+\b")
_HOUSE = re.compile(r"\b(?:h no|house no|plot no|plot|no)\b(?= \S)")
_REGION = re.compile(r"\b(?:" + "|".join(sorted([*X.REGIONS.values(), *(k for k in X.REGIONS if len(k) > 1)], key=len, reverse=True)) + r")\b")
_NUMBER = {w: str(i) for i, w in enumerate(X.NUMBER_WORDS)}
_SPLIT_CODE = re.compile(r"\b(\d{3}) (\d{3})\b")
_EXTENDED = re.compile(r"\b(\d{5}) \d{4}\b")
_TWO_NUMBERS = re.compile(r"\d \d")
_JOINED = re.compile(r"^(.{3,}?)(allee|strasse|straße|gasse|platz|weg|str|alle|gss|pltz)$")
_JOINED_SHORT = re.compile(r"^(.{3,}?)(allee|strasse|straße|gasse|platz|weg|str|alle|gss|pltz|wg|pl|al|g)$")


@lru_cache(maxsize=100_000)
def is_town(word: str) -> bool:
    return len(word) > 5 and plain(word).endswith(X.TOWN_ENDS)


@lru_cache(maxsize=400_000)
def _tag(word: str) -> str:
    """What a word is (number, kind, town, other) wherever it stands, if not before the second word of a town; '' where
    its place decides."""
    if word.isdigit():
        return "n"
    if len(word) < 2 or word in ("no", "plot", "main", "mn"):
        return ""
    return "k" if word in _KIND else "t" if word in X.TOWN_SECONDS or is_town(word) else "o"


def _beside(tags: list[str], at: int, step: int) -> list[int]:
    """Places of the numbers next to the street, going one way."""
    out = []
    while 0 <= at < len(tags) and tags[at] in "n-":
        if tags[at] == "n":
            out.append(at)
        at += step
    return out


def read(address: str, country: str | None) -> tuple[list[str], str, str, str, str] | None:
    """(possible house numbers, street, kind of street, town, code); None where no building is named.

    Street and town are skeletons; kind, town and code are '' where they are missing.
    """
    if not any(c.isdigit() for c in address) and not any(w in _NUMBER for w in address.split()):
        return None
    text = _LANDMARK.sub(" ", address)
    text = _UNIT.sub(" ", text)
    text = text.replace("lay out", "layout")
    if _TWO_NUMBERS.search(text):
        text = _EXTENDED.sub(r"\1", text)
        text = _SPLIT_CODE.sub(r"\1\2", text)
    text = _REGION.sub(" ", text)
    words = [(_NUMBER.get(w, w)) for w in text.split()]
    code = ""
    rest: list[str] = []
    for w in words:
        if w.isdigit() and len(w) in (5, 6) and not code and not (len(w) == 5 and w[0] == "0"):
            code = w
        else:
            rest.append(w)
    words = rest
    singapore = any(w in X.TOWN_SECONDS for w in words)
    # Words by what they are: number, kind, town, other.
    tags = []
    n = len(words)
    for i, w in enumerate(words):
        if tag := _tag(w):
            tags.append(tag if tag != "o" or i + 1 == n or words[i + 1] not in X.TOWN_SECONDS else "t")
        elif w in ("no", "h", "plot") and i + 1 < n:
            tags.append("-")
        elif i and tags[-1] == "n" and len(w) == 1 and not (w == "g" or w == "x"):
            tags.append("-")
        elif w in _KIND:
            tags.append("k")
        elif w in ("main", "mn", "m") and i + 1 < n and words[i + 1] in ("road", "rd"):
            tags.append("m")
        elif w == "c" and singapore:
            tags.append("-")
        elif w in X.TOWN_SECONDS or is_town(w) or i + 1 < n and words[i + 1] in X.TOWN_SECONDS:
            tags.append("t")
        else:
            tags.append("o")
    kind, street, numbers = "", "", []
    german = country == "germany" or any(t == "t" and w.endswith(("dorf", "stadt", "hausen", "bruck")) for w, t in zip(words, tags))
    used: set[int] = set()
    ks = [i for i, t in enumerate(tags) if t == "k"]
    # The kind of street stands right after the words of the street.
    for i in ks:
        j = i - 1
        if j >= 0 and tags[j] == "m":
            j -= 1
        first = j
        while first >= 0 and tags[first] == "o":
            first -= 1
        own = words[first + 1 : j + 1]
        if not own and j >= 0 and tags[j] == "t":
            first, own = j - 1, [words[j]]
        if own and not street:
            street = "".join(own)
            kind = ("main " if j < i - 1 else "") + (_KIND[words[i]] if not german or words[i] != "str" else "strasse")
            used = set(range(first + 1, i + 1))
    if not street:
        joined = _JOINED_SHORT if german else _JOINED
        for i, w in enumerate(words):
            m = joined.match(w) if tags[i] in "ot" else None
            if m:
                first = i
                while first and tags[first - 1] == "o":
                    first -= 1
                street, kind, used = "".join(words[first:i]) + m[1], "strasse" if m[2] == "str" else _KIND[m[2]], set(range(first, i + 1))
                break
    if not street:
        # No kind: the other word next to the house number.
        for spot in (i for i, t in enumerate(tags) if t == "n"):
            for step in (1, -1):
                j = spot + step
                while 0 <= j < n and tags[j] in "-n":
                    j += step
                own = []
                while 0 <= j < n and tags[j] == "o" and len(own) < 2:
                    own.append(j)
                    j += step
                if own and max(len(words[x]) for x in own) > 2:
                    used = set(own)
                    street = "".join(words[x] for x in sorted(own))
                    break
            if street:
                break
    if not street:
        return None
    digits = [i for i, t in enumerate(tags) if t == "n"]
    if not digits:
        return None
    picked = _beside(tags, min(used) - 1, -1)[::-1] or _beside(tags, max(used) + 1, 1) or digits[:1]
    numbers = list(dict.fromkeys(words[i].lstrip("0") or "0" for i in picked))
    if len(numbers) > 1 and numbers[-1] != "1":  # unit and house, rather than house and suffix
        numbers.reverse()
    town = "".join(skeleton(words[i]) for i in range(n) if i not in used and tags[i] == "t")
    if not town:
        town = "".join(skeleton(words[i]) for i in range(n) if i not in used and tags[i] == "o" and len(words[i]) > 2)
    return numbers, skeleton(street), kind, town, code


NODE = ["num", "street", "kind", "town", "code"]


def readings(addresses: DataFrame, keys: tuple[str, ...] = ("address", "country")) -> DataFrame:
    """``keys, n, place, places, num, street, kind, town, code`` of distinct addresses (columns ``address, country, n``),
    ``place`` 0 for the likelier house number and ``places`` how many there are.

    ``keys`` are the columns that identify an address: itself, or signatures in its place. An address that names no
    building has no row.
    """
    columns = list(dict.fromkeys(["address", "country", *keys]))
    distinct = addresses.filter(F.col("address") != "").select(*columns, F.col("n").cast("long"))

    def run(batch: dict[str, list]) -> dict[str, list]:
        rows = []
        for a, c, *own in zip(batch["address"], batch["country"], *(batch[k] for k in keys), batch["n"]):
            r = read(a, c)
            if r:
                rows += [(*own, i, len(r[0]), num, *r[1:]) for i, num in enumerate(r[0])]
        names = (*keys, "n", "place", "places", *NODE)
        return dict(zip(names, map(list, zip(*rows) if rows else ((),) * len(names))))

    kept = ", ".join(f"{k} {distinct.schema[k].dataType.simpleString()}" for k in keys)
    return map_columns(distinct, run, f"{kept}, n long, place int, places int, " + ", ".join(f"{x} string" for x in NODE))


def with_towns(read_: DataFrame) -> DataFrame:
    """Fills a missing town with the one most readings have with the same code."""
    seen = read_.filter("place = 0 AND town <> '' AND code <> ''").groupBy("code", "town").agg(F.count(F.lit(1)).alias("n"))
    usual = seen.groupBy("code").agg(F.max(F.struct("n", "town")).alias("m")).select("code", F.col("m.town").alias("usual"))
    return read_.join(usual, "code", "left").withColumn("town", F.when(F.col("town") == "", F.coalesce("usual", F.lit(""))).otherwise(F.col("town"))).drop("usual")


def _bits(text: str) -> tuple[Column, Column]:
    """Numbers of the keys of a text, and the key of number ``i``; any text that is ``near`` it, or within two edits of six
    and more characters, has one of its keys too.

    1 to 4: its first four characters with one left out; 5: its last four. Of two edits, either one at most is in the
    first four characters, or both are, and then the last four of eight and more are whole. 6 and 7: in the middle of
    short texts two edits leave two characters at either end, or the same letters. 8 to 11: the last four of texts of six
    and seven characters with one left out.
    """
    c, i = F.col(text), F.col("i")
    n = F.length(c)
    out = lambda mark, part, at: F.concat(F.lit(mark), F.substring(part, F.lit(1), at - 1), F.substring(part, at + 1, F.lit(4)))
    tail = F.right(c, F.lit(4))
    key = (
        F.when(i <= 4, out("<", F.left(c, F.lit(4)), i))
        .when(i == 5, F.when(n < 4, F.concat(F.lit("<"), c)).otherwise(F.concat(F.lit(">"), tail)))
        .when(i == 6, F.concat(F.lit("="), F.left(c, F.lit(2)), F.right(c, F.lit(2))))
        .when(i == 7, F.concat(F.lit("~"), F.array_join(F.sort_array(F.split(c, "")), "")))
        .otherwise(out(")", tail, i - 7))
    )
    numbers = [[5], [1, 5, 6, 7], [1, 2, 5, 6, 7], [1, 2, 3, 5, 6, 7], [1, 2, 3, 4, 6, 7], [1, 2, 3, 4, 6, 7], [*range(1, 12)], [*range(1, 12)]]
    of = F.lit([1, 2, 3, 4, 5])
    for size, x in enumerate(numbers):
        of = F.when(n == size, F.lit(x)).otherwise(of)
    return of, key


def _meetings(nodes: DataFrame) -> DataFrame:
    """``a, b``: ids of all nodes with one number that agree in two of street, town and code, or in one of town and code
    with a street spelt nearly alike, or in the street with a town spelt nearly alike.

    Of complete nodes that agree in street, kind, and town or code, each meets only the heaviest: all of them are
    neighbours, and no other of them can be the heaviest neighbour of any.
    """
    def keyed_by(some: Column, of: str, apart: str) -> DataFrame:
        numbers, key = _bits(apart)
        rows = nodes.filter(some).select("id", "full", F.xxhash64(apart).alias("own"), F.xxhash64(F.lit(of + apart), "num", of).alias("shared"), apart, F.explode(numbers).alias("i"))
        return rows.select("id", "full", "own", F.xxhash64("shared", key).alias("k"))

    rows = [keyed_by(F.col("code") != "", "code", "street"), keyed_by(F.lit(True), "town", "street"), keyed_by(F.col("town") != "", "street", "town")]
    # Readings that lack something meet every complete one with the same street, not only the heaviest.
    rows += [nodes.filter(F.col(of) != "").select("id", "full", F.col("full").cast("long").alias("own"), F.xxhash64(F.lit(of), "num", of, "street").alias("k")) for of in ("code", "town")]
    keyed = reduce(DataFrame.unionByName, rows)
    # Most keys have no pair; only rows of the others are written and joined.
    w = W.partitionBy("k")
    keyed = keyed.select("*", F.min("own").over(w).alias("lo"), F.max("own").over(w).alias("hi"), F.max("full").over(w).alias("any"))
    keyed = materialize(keyed.filter("lo <> hi AND any").select("id", "full", "own", "k"), "meetings")
    x, y = keyed.alias("x"), spread(keyed).alias("y")
    met = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.own") != F.col("y.own")) & (F.col("x.full") | F.col("y.full")))
    pairs = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    for of in ("code", "town"):
        w = W.partitionBy("num", "street", "kind", of).orderBy(F.desc("weight"), "id")
        hub = nodes.filter(F.col("full") & (F.col(of) != "")).select("id", F.first("id").over(w).alias("hub")).filter("id <> hub")
        pairs = pairs.unionByName(hub.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")))
    return pairs.distinct()


def _neighbours(nodes: DataFrame, block: list[str], order: list[Column], window: int) -> DataFrame:
    """Pairs of nodes at most ``window`` apart in the order of ``order`` inside each block, with streets within two edits."""
    w = W.partitionBy(*block).orderBy(*order, "id")
    me = F.struct("id", *NODE, "full", "weight")
    seen = nodes.select(me.alias("a"), *[F.lag(me, k).over(w).alias(f"b{k}") for k in range(1, window + 1)])
    # Streets more than two edits apart are no place (``same_place``); they are left out before rows are made of the others.
    close = lambda b: F.when(F.levenshtein(F.col("a.street"), F.col(f"{b}.street"), 2) >= 0, F.col(b))
    return seen.select("a", F.explode(F.array_compact(F.array(*[close(f"b{k}") for k in range(1, window + 1)]))).alias("b"))


def same_place(unit: Column) -> Column:
    """Whether two neighbours ``a`` and ``b`` can be one building: number and kind strictly, street and town with edits."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    kinds = (a("kind") == b("kind")) | (a("kind") == "") | (b("kind") == "")
    towns = (a("town") != "") & (b("town") != "")
    codes = (a("code") != "") & (b("code") != "")
    town_same = towns & (near(a("town"), b("town")) | (F.length(a("town")) >= 5) & (F.startswith(a("town"), b("town")) | F.startswith(b("town"), a("town"))))
    code_same = codes & (a("code") == b("code"))
    code_near = codes & near(a("code"), b("code"))
    unknown = ((a("town") == "") & (a("code") == "")) | ((b("town") == "") & (b("code") == ""))
    place = town_same | (code_same & (~towns | (a("street") == b("street")))) | (code_near & ~towns) | unknown | (~towns & ~codes & ~(a("full") & b("full")))
    loose = town_same & code_same & (F.least(F.length(a("street")), F.length(b("street"))) >= 6) & (F.levenshtein(a("street"), b("street"), 2) >= 0)
    rare = (a("street") == b("street")) | much_rarer(a("weight"), b("weight"), unit)
    return (a("num") == b("num")) & kinds & rare & (near(a("street"), b("street")) | loose) & place


def buildings(addresses: DataFrame, window: int = 4, keys: tuple[str, ...] = ("address", "country")) -> DataFrame:
    """``keys, building``: distinct addresses (columns ``address, country, n``, and ``keys``) with the building they denote.

    All readings meet that agree in one of street, town and code and are spelt nearly alike in another, however many a
    building has. Further passes sort by (number, street) and (number, street from its end) in blocks of two letters, for
    readings with several parts misspelt; every distinct reading takes part, so repeated addresses cost nothing and never
    fill a window. Complete readings are grouped first. A reading without its kind, or without town and code, joins a
    building only if all its neighbours agree on one; else it stays by itself. Null and empty addresses, and those of no
    building, have no row.
    """
    key = F.xxhash64(*NODE)
    read_ = with_towns(materialize(readings(addresses, keys), "readings")).withColumn("id", key)
    full = (F.col("kind") != "") & ((F.col("town") != "") | (F.col("code") != ""))
    nodes = materialize(read_.filter("place = 0").groupBy("id", *NODE).agg(F.sum("n").alias("weight")).withColumn("full", full), "places")
    street = nodes.withColumns({"head": F.left("street", F.lit(2)), "tail": F.right("street", F.lit(2))})
    passes = [
        (street, ["num", "head"], [F.col("street"), F.col("town")]),
        (street, ["num", "tail"], [F.reverse("street"), F.col("town")]),
    ]
    side = lambda x: nodes.select(F.col("id").alias(x), F.struct("id", *NODE, "full", "weight").alias(f"{x}_"))
    met = _meetings(nodes).join(spread(side("a")), "a").join(spread(side("b")), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b"))
    alike = same_place(usual(nodes))
    pairs = reduce(DataFrame.unionByName, [met.filter(alike)] + [_neighbours(n, block, order, window).filter(alike) for n, block, order in passes])
    edges = pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.full").alias("fa"), F.col("b.full").alias("fb"))
    edges = materialize(edges.distinct(), "place_pairs")
    whole = roots(nodes.filter("full").select("id", "weight"), edges.filter("fa and fb").select("a", "b"))
    # A partial reading joins when its complete neighbours agree.
    part = edges.filter("fa <> fb").select(F.when(F.col("fa"), F.col("b")).otherwise(F.col("a")).alias("id"), F.when(F.col("fa"), F.col("a")).otherwise(F.col("b")).alias("of"))
    agreed = part.join(spread(whole.select(F.col("id").alias("of"), "root")), "of").groupBy("id").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 = r1").select("id", F.col("r0").alias("root"))
    known = whole.select("id", "root").unionByName(agreed)
    placed = read_.select(*keys, "place", "places", "id").join(spread(known), "id", "left").withColumn("building", F.coalesce("root", "id")).drop("root")
    placed = materialize(placed, "placed")
    sure = placed.filter("places = 1").select(*keys, "building")
    # Of two possible house numbers the likelier one counts, unless only the other meets a building of other addresses.
    open_ = placed.filter("places > 1")
    sizes = placed.filter("place = 0").join(spread(open_.select("building").distinct()), "building", "left_semi").groupBy("building").agg(F.count(F.lit(1)).alias("size"))
    best = F.struct(F.when((F.col("place") == 0) & (F.col("size") > 1), 3).when((F.col("place") > 0) & (F.col("size") >= 1), 2).otherwise(1).alias("rank"), (-F.col("place")).alias("p"), F.col("building").alias("building"))
    chosen = open_.join(spread(sizes), "building", "left").groupBy(*keys).agg(F.max(best).alias("m")).select(*keys, F.col("m.building").alias("building"))
    return sure.unionByName(chosen)


def same_building(records: DataFrame) -> DataFrame:
    """Pairs ``id_a, id_b`` of different entities with different addresses of one building (columns ``entity_id, address, country``)."""
    distinct = records.select("entity_id", "address", "country").distinct()
    counted = distinct.groupBy("address", "country").agg(F.count(F.lit(1)).alias("n"))
    b = buildings(counted)
    at = distinct.join(spread(b), [distinct["address"] == b["address"], distinct["country"].eqNullSafe(b["country"])]).select("entity_id", distinct["address"], "building")
    at = materialize(at.distinct(), "at_building")
    x, y = at.alias("x"), spread(at).alias("y")
    on = (F.col("x.building") == F.col("y.building")) & (F.col("x.entity_id") < F.col("y.entity_id")) & (F.col("x.address") != F.col("y.address"))
    return x.join(y, on).select(F.col("x.entity_id").alias("id_a"), F.col("y.entity_id").alias("id_b")).distinct()
