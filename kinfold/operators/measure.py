"""Blocking quality: recall on true links, pair volume without pairs, distributions, caps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eval_table(links: DataFrame, s1: DataFrame, cand: DataFrame, columns: list[str], stray: bool = False) -> DataFrame:
    """True links with ``columns`` of both records as ``a_*`` and ``b_*``: two id joins, no many-to-many join.

    With ``stray`` links that point at no candidate record stay, with nulls.
    """
    a = s1.select(F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = cand.select(F.col("entity_id").alias("cand_id"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return links.join(a, "s1_id").join(b, "cand_id", "left" if stray else "inner")


def same(key: str, other: str | None = None) -> Column:
    """Three-valued equality of the keys of both records."""
    return F.col(f"a_{key}") == F.col(f"b_{other or key}")


def any_of(*rules: Column) -> Column:
    return reduce(lambda x, y: x | y, rules)


def recall(df: DataFrame, rules: dict[str, Column], total: DataFrame) -> DataFrame:
    """One row per rule: hits, all links of ``total``, and their ratio. One pass over the links for all rules."""
    counts = df.agg(*[F.count_if(p).alias(n) for n, p in rules.items()])
    names = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("hits")) for n in rules])
    all_links = total.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        counts.select(F.explode(names).alias("x")).select("x.rule", "x.hits")
        .withColumn("total_links", all_links)
        .withColumn("recall", F.col("hits") / F.nullif(F.col("total_links"), F.lit(0)))
    )


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per key, null keys left out."""
    present = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    return df.filter(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))


def pair_volume(a: DataFrame, b: DataFrame, left: str, right: str | None = None) -> DataFrame:
    """Number of pairs a key would join, from two histograms; no pair is made. 128-bit products, then cast."""
    ha = histogram(a, left).select(F.col(left).alias("k"), F.col("cnt").alias("ca"))
    hb = histogram(b, right or left).select(F.col(right or left).alias("k"), F.col("cnt").alias("cb"))
    product = F.col("ca").cast("decimal(38,0)") * F.col("cb")
    return ha.join(hb, "k").agg(F.coalesce(F.sum(product), F.lit(0)).cast("long").alias("pairs"))


def distribution(df: DataFrame, column: str, tails: tuple[int, ...] = (100, 1000, 10000, 100000), by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Count, sum, mean, exact interpolated percentiles, maximum and tail counts of a numeric column, for each of ``by``.

    Equal values are counted first, so the percentile state holds one counter per distinct value. ``weight`` is a column
    of how many entities a row stands for.
    """
    by = by or []
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    w = df.groupBy(*by, F.col(column).alias("v")).agg(rows.alias("w")).filter("w > 0")
    v, n = F.col("v"), F.col("w")
    total = F.sum(v * n).cast("long")
    return w.groupBy(*by).agg(
        F.sum(n).cast("long").alias("entities"), total.alias("total"), (total / F.sum(n)).alias("mean"),
        *[F.percentile(v, F.lit(p), n).alias(f"p{round(p * 100)}") for p in (0.5, 0.9, 0.95, 0.99)],
        F.max(v).cast("long").alias("largest"), F.sum(F.when(v == 0, n).otherwise(0)).cast("long").alias("zero"),
        *[F.sum(F.when(v > t, n).otherwise(0)).cast("long").alias(f"over_{t}") for t in tails],
    )


#: Fixed values. Size class and its largest size.
BUCKETS = [("0", 0), ("1-10", 10), ("11-100", 100), ("101-1K", 1000), ("1K-10K", 10000), ("10K-100K", 100000)]


def buckets(df: DataFrame, column: str) -> DataFrame:
    """Entities by size class, in order of size."""
    place = F.lit(len(BUCKETS))
    label = F.lit(">100K")
    for i, (name, top) in reversed(list(enumerate(BUCKETS))):
        place = F.when(F.col(column) <= top, F.lit(i)).otherwise(place)
        label = F.when(F.col(column) <= top, F.lit(name)).otherwise(label)
    return df.groupBy(place.alias("place"), label.alias("bucket")).agg(F.count(F.lit(1)).alias("entities")).orderBy("place").drop("place")


def candidate_counts(s1: DataFrame, s2: DataFrame, s3: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates per left entity and source by one (composite) key.

    One histogram of both sources, one left join; rows without a key take no part in it and have none.
    """
    tagged = s2.select(*keys, F.lit(2).alias("src")).unionByName(s3.select(*keys, F.lit(3).alias("src")))
    present = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    sizes = tagged.filter(present).groupBy(*keys).agg(F.count_if(F.col("src") == 2).alias("c2"), F.count_if(F.col("src") == 3).alias("c3"))
    c2, c3 = F.coalesce("c2", F.lit(0)), F.coalesce("c3", F.lit(0))
    counted = s1.filter(present).join(sizes, keys, "left").select("entity_id", c2.alias("s2_cands"), c3.alias("s3_cands"))
    without = s1.filter(~present).select("entity_id", F.lit(0).cast("long").alias("s2_cands"), F.lit(0).cast("long").alias("s3_cands"))
    return counted.unionByName(without).withColumn("total_cands", F.col("s2_cands") + F.col("s3_cands"))


def union_counts(s1: DataFrame, cands: dict[str, DataFrame]) -> DataFrame:
    """``entity_id`` and, by name of the candidate table, how many of its records share the key of at least one rule of ``blocking.RULES``.

    No pair is made. By inclusion and exclusion the size of the union follows from the numbers of records that agree on
    combinations of keys: histograms of 96-bit hashes of combinations, joined once. With equal house numbers (u) a pair
    matches where beginning of name, number with postal code (or address), or one of three word equalities agree; without,
    where name, address or postal code with four letters do. Ids must be unique, and normalised names and addresses hold
    no bars. Entities without any candidate have no row.
    """
    n, a, post, u = F.col("name_norm"), F.col("block_address_exact"), F.col("block_postal"), _number_key()
    first4, first5 = F.when(F.length(n) >= 4, F.substring(n, 1, 4)), F.when(n != "", F.substring(n, 1, 5))
    word = lambda i: F.when(F.length(f"w{i}") >= 4, F.col(f"w{i}"))
    w1, w2, name = word(1), word(2), F.col("block_name_exact")
    twice = F.when(F.col("w1") == F.col("w2"), w2)
    unnumbered = F.when(F.col("addr_num") == "", a)
    long_name = F.when(F.length(n) >= 4, name)
    place = F.coalesce(post, a)
    # Sign, key of the left and of the right record.
    alone = [(1, [name]), (1, [unnumbered]), (1, [post, first4]), (-1, [name, unnumbered]), (-1, [long_name, post]), (-1, [u, name]), (-1, [u, post, first4]), (1, [u, long_name, post])]
    terms = [(sign, key, key) for sign, key in alone]
    # Combinations of: left word 1 is right word 2, left 2 is right 1, both second words are equal. Two of them with one right
    # (left) word have rows only where the left (right) words are equal.
    words = [(-1, [], []), (1, [w1], [w2]), (1, [w2], [w1]), (1, [w2], [w2]), (-1, [w1, w2], [w2, w1]), (-1, [twice], [w2]), (-1, [w2], [twice]), (1, [twice], [twice])]
    for more, own in ((1, []), (-1, [first5]), (-1, [place]), (1, [first5, place])):
        terms += [(sign * more, [u, *own, *l], [u, *own, *r]) for sign, l, r in words if own or l]

    def rows(side: int) -> Column:
        out = []
        for i, t in enumerate(terms):
            present = reduce(lambda x, y: x & y, [c.isNotNull() for c in t[side]])
            out.append(F.when(present, F.struct(F.xxhash64(F.lit(i), *t[side]).alias("k"), F.hash(F.lit(i), *t[side]).alias("h"), F.lit(t[0]).alias("sign"))))
        return F.inline(F.array_compact(F.array(*out)))

    tagged = reduce(DataFrame.unionByName, [t.select(F.lit(x).alias("src"), rows(2)).drop("sign") for x, t in cands.items()])
    sizes = tagged.groupBy("k", "h").agg(*[F.count_if(F.col("src") == x).alias(x) for x in cands])
    hits = s1.select("entity_id", rows(1)).join(sizes, ["k", "h"])
    return hits.groupBy("entity_id").agg(*[F.sum(F.col("sign") * F.col(x)).alias(x) for x in cands])


def _number_key() -> Column:
    return F.when(F.col("addr_num") != "", F.concat("country_norm", F.lit("|"), "addr_num"))


def cross_counts(s1: DataFrame, s2: DataFrame, s3: DataFrame, one: str, two: str) -> DataFrame:
    """``entity_id, upper_bound, exact``: candidates whose key ``one`` is the entity's ``two`` or the other way round.

    ``upper_bound`` counts a candidate that matches both ways twice; ``exact`` takes off those, counted by both keys at
    once. Histograms of all three kinds are unpivoted and joined once; no pair is made, and null keys do not travel.
    """
    def kinds(first: str, second: str) -> Column:
        both = F.when(F.col(first).isNotNull() & F.col(second).isNotNull(), F.xxhash64(first, second))
        of = [(0, F.xxhash64(first), F.col(first).isNotNull(), 1), (1, F.xxhash64(second), F.col(second).isNotNull(), 1), (2, both, both.isNotNull(), -1)]
        rows = F.array(*[F.struct(F.lit(i).alias("kind"), F.when(ok, k).alias("k"), F.lit(sign).alias("sign")) for i, k, ok, sign in of])
        return F.filter(rows, lambda x: x["k"].isNotNull())

    cand = s2.select(one, two).unionByName(s3.select(one, two)).select(F.inline(kinds(two, one)))
    sizes = cand.groupBy("kind", "k", "sign").agg(F.count(F.lit(1)).alias("n"))
    hits = s1.select("entity_id", F.inline(kinds(one, two))).drop("sign").join(sizes, ["kind", "k"]).select("entity_id", "sign", "n")
    all_ = hits.unionByName(s1.select("entity_id", F.lit(1).alias("sign"), F.lit(0).cast("long").alias("n")))
    return all_.groupBy("entity_id").agg(F.sum(F.when(F.col("sign") > 0, F.col("n")).otherwise(0)).alias("upper_bound"), F.sum(F.col("sign") * F.col("n")).alias("exact"))


def block_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks, rows, mean and largest block of each key, all keys in one unpivoted pass."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key_name"), F.col(k).alias("key")) for k in keys])).alias("x")).select("x.key_name", "x.key")
    per_key = long.filter(F.col("key").isNotNull()).groupBy("key_name", "key").agg(F.count(F.lit(1)).alias("cnt"))
    return per_key.groupBy("key_name").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum("cnt").alias("rows"), F.avg("cnt").alias("mean_block"), F.max("cnt").alias("largest_block")
    )


def block_frequency(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows per key and source, with the largest and the total: tagged rows and one aggregation, no outer joins."""
    tagged = reduce(DataFrame.unionByName, [t.select(F.col(key).alias("block_key"), F.lit(n).alias("src")) for n, t in tables.items()])
    counts = [F.count_if(F.col("src") == n).alias(f"{n}_cnt") for n in tables]
    sizes = [F.col(f"{n}_cnt") for n in tables]
    return (
        tagged.filter(F.col("block_key").isNotNull()).groupBy("block_key").agg(*counts)
        .withColumn("max_cnt", F.greatest(*sizes)).withColumn("total_cnt", reduce(lambda x, y: x + y, sizes))
    )


#: Two meanings of the size of a block: the largest of any source, and the larger of the two candidate sources.
CAPS = {"symmetric": lambda: F.col("max_cnt"), "candidate": lambda: F.greatest("s2_cnt", "s3_cnt")}


def _rows(names: dict[str, dict[int, dict[str, Column]]]) -> Column:
    return F.inline(F.array(*[F.struct(F.lit(n).alias("cap_kind"), F.lit(t).alias("cap"), *[c.alias(k) for k, c in of.items()]) for n, by in names.items() for t, of in by.items()]))


def capped(freq: DataFrame, evaluated: DataFrame, key: str, exact: Column, base: Column, caps: list[int]) -> DataFrame:
    """Recall and volume of a key limited to blocks of at most T rows, for both meanings of the size, all T at once.

    ``hits`` are links the capped rule recovers (``s2_hits``, ``s3_hits`` by ``target_source``), ``new_hits`` those that
    ``exact`` does not have, ``with_exact`` and ``with_base`` those of the union; ``pairs`` is the volume by source.
    """
    hit = same(key)
    sizes = freq.select(F.col("block_key").alias(f"a_{key}"), "s2_cnt", "s3_cnt", "max_cnt")
    known = evaluated.filter(F.col(f"a_{key}").isNotNull()).join(sizes, f"a_{key}", "left")
    links = known.unionByName(evaluated.filter(F.col(f"a_{key}").isNull()), allowMissingColumns=True)
    yes = lambda c: F.coalesce(c, F.lit(False))
    recovered = {(n, t): yes(hit & (size() <= t)) for n, size in CAPS.items() for t in caps}
    kinds = {"hits": lambda r: r, "s2_hits": lambda r: r & (F.col("target_source") == "S2"), "s3_hits": lambda r: r & (F.col("target_source") == "S3"),
             "new_hits": lambda r: r & ~yes(exact), "with_exact": lambda r: r | yes(exact), "with_base": lambda r: r | yes(base)}
    hits = links.agg(*[F.count_if(f(r)).alias(f"{k}_{n}_{t}") for (n, t), r in recovered.items() for k, f in kinds.items()])
    volumes = {"s2_pairs": F.col("s1_cnt") * F.col("s2_cnt"), "s3_pairs": F.col("s1_cnt") * F.col("s3_cnt")}
    vols = freq.agg(*[F.coalesce(F.sum(F.when(size() <= t, v)), F.lit(0)).cast("long").alias(f"{k}_{n}_{t}") for n, size in CAPS.items() for t in caps for k, v in volumes.items()])
    h = hits.select(_rows({n: {t: {k: F.col(f"{k}_{n}_{t}") for k in kinds} for t in caps} for n in CAPS}))
    v = vols.select(_rows({n: {t: {k: F.col(f"{k}_{n}_{t}") for k in volumes} for t in caps} for n in CAPS}))
    return h.join(v, ["cap_kind", "cap"]).withColumn("pairs", F.col("s2_pairs") + F.col("s3_pairs"))


def capped_distribution(freq: DataFrame, s1: DataFrame, key: str, caps: list[int]) -> DataFrame:
    """Distribution of candidates per left row for each cap, from block sizes alone: a block stands for its left rows.

    Left rows without a key, or of a block above the cap, have no candidates.
    """
    within = F.array(*[F.struct(F.lit(n).alias("cap_kind"), F.lit(t).alias("cap"), F.when(size() <= t, F.col("s2_cnt") + F.col("s3_cnt")).otherwise(0).alias("cands")) for n, size in CAPS.items() for t in caps])
    rows = freq.filter("s1_cnt > 0").select(F.col("s1_cnt").alias("n"), F.inline(within))
    none = s1.agg(F.count_if(F.col(key).isNull()).alias("n")).select("n", F.inline(F.array(*[F.struct(F.lit(n).alias("cap_kind"), F.lit(t).alias("cap"), F.lit(0).cast("long").alias("cands")) for n in CAPS for t in caps])))
    return distribution(rows.unionByName(none), "cands", by=["cap_kind", "cap"], weight="n")
