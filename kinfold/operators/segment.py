"""Several values packed in one field, split into one row per value (dictionary-guided segmentation).

Delimiters and quoting are not parsed at all. Values are *found*: a multi-pattern automaton over the known values that can
occur finds every whole known value, and where finds overlap, dynamic programming takes the cover with the most
characters, then the fewest pieces, so a delimiter inside a known value is protected. The general form, a regular
expression, is asked only where no known value was found: it gives the values that have no record.

The dictionary may be of any size: every value has an *anchor*, its part of general form or else its longest run of
letters or digits, and only the values whose anchor occurs in a list travel to that list, by an equi-join. The automaton
of a batch holds just those.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.session import map_batches, spread


def automaton(values: set[str]):
    """Multi-pattern automaton, None for no values."""
    import ahocorasick

    if not values:
        return None
    a = ahocorasick.Automaton()
    for v in values:
        a.add_word(v, len(v))
    a.make_automaton()
    return a


def best_cover(finds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint intervals [start, end) of the most covered characters, then the fewest pieces, in order."""
    finds = sorted(set(finds), key=lambda x: (x[1], x[0]))
    if all(a[1] <= b[0] for a, b in zip(finds, finds[1:])):
        return finds
    ends = [e for _, e in finds]
    best: list[tuple[int, int]] = [(0, 0)]
    for i, (s, e) in enumerate(finds):
        j = bisect_right(ends, s, 0, i)
        best.append(max(best[-1], (best[j][0] + e - s, best[j][1] - 1)))
    out, i = [], len(finds)
    while i:
        if best[i] == best[i - 1]:
            i -= 1
        else:
            out.append(finds[i - 1])
            i = bisect_right(ends, finds[i - 1][0], 0, i - 1)
    return out[::-1]


def segment_text(text: str | None, pattern: re.Pattern, auto) -> list[str]:
    """The values of one list in written order: the best cover by known values, and the general form in the gaps."""
    if not text:
        return []
    general = [m.span() for m in pattern.finditer(text)]
    known: list[tuple[int, int]] = []
    if auto is not None:
        starts, n = {s for s, _ in general}, len(text)
        for last, size in auto.iter(text):
            s, e = last + 1 - size, last + 1
            if (e == n or e in starts or not text[e].isalnum()) and (s == 0 or s in starts or not text[s - 1].isalnum()):
                known.append((s, e))
    found = best_cover(known)
    if found != general:
        at, gaps = 0, []
        for s, e in general:
            while at < len(found) and found[at][1] <= s:
                at += 1
            if at == len(found) or e <= found[at][0]:
                gaps.append((s, e))
        found = sorted(found + gaps)
    return [text[s:e] for s, e in found]


def segment(lists: DataFrame, keys: list[str], packed: str, dictionary: DataFrame, pattern: str) -> DataFrame:
    """One row ``keys, pos, value`` per value of ``packed``; ``pos`` (int) counts from 1 in written order.

    ``dictionary`` has one column of known values, of any form; ``pattern`` is the general form of values that may have no
    record, a regular expression that Java and Python read alike. Null, empty and value-free texts give no rows; repeated
    values keep a row each; rows of ``lists`` with equal keys and text count once; other columns are ignored; dictionary
    nulls, repeats and values without a letter or digit do no harm. A list is handled whole in one task, however long.
    """
    lists = lists.select(*keys, F.col(packed).alias("packed_")).filter(F.col("packed_").isNotNull()).distinct()
    known = dictionary.select(F.col(dictionary.columns[0]).alias("value_")).filter(F.col("value_") != "")
    runs = lambda c: F.regexp_extract_all(c, F.lit(r"(\p{L}+|\p{N}+)"), F.lit(1))
    longest = F.array_max(F.transform(runs("value_"), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    own = F.regexp_extract("value_", pattern, 0)
    known = known.withColumns({"formed_": own != "", "anchor_": F.when(own != "", own).otherwise(longest)}).filter(F.col("anchor_").isNotNull())
    # Runs of letters and digits are looked up only if there are values without the general form, and from their least length on.
    least = known.filter("NOT formed_").agg(F.min(F.length("anchor_")).alias("n")).scalar()
    row = F.xxhash64(*keys, "packed_")
    forms = F.regexp_extract_all("packed_", F.lit(f"({pattern})"), F.lit(1))
    other = F.when(F.col("least_").isNull(), F.array().cast("array<string>")).otherwise(F.filter(runs("packed_"), lambda x: F.length(x) >= F.col("least_")))
    found = lists.withColumn("least_", least).select(row.alias("row_"), F.explode(F.array_distinct(F.concat(forms, other))).alias("anchor_"))
    needed = spread(found).join(known.select("anchor_", "value_"), "anchor_").groupBy("row_").agg(F.collect_set("value_").alias("known_"))
    lists = lists.withColumn("row_", row).join(needed, "row_", "left")
    names = [f.name for f in lists.select(*keys).schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = re.compile(pattern)
        for pdf in batches:
            auto = automaton({v for k in pdf["known_"] if k is not None for v in k})
            out = pdf[names].copy()
            out["values_"] = [segment_text(t, compiled, auto) for t in pdf["packed_"]]
            yield out

    fields = ", ".join(f"`{n}` {lists.schema[n].dataType.simpleString()}" for n in names)
    values = map_batches(lists, run, f"{fields}, values_ array<string>")
    return values.select(*keys, F.posexplode("values_").alias("p_", "value")).select(*keys, (F.col("p_") + 1).alias("pos"), "value")
