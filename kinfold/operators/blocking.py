"""Candidate generation: the union of equi-join blocking rules, with three-valued rule flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import keys as K
from kinfold.session import materialize

#: Fixed values. Join name, key of the left record, key of the right record, flag it sets.
RULES = [
    ("exact_name", "block_name_exact", "block_name_exact", "match_exact_name"),
    ("exact_addr", "block_address_exact", "block_address_exact", "match_exact_addr"),
    ("addr_name5", "k_addr_name5", "k_addr_name5", "match_addr_name5"),
    ("cross_a", "k_addr_w1", "k_addr_w2", "match_cross_word"),
    ("cross_b", "k_addr_w2", "k_addr_w1", "match_cross_word"),
    ("addr_w2", "k_addr_w2", "k_addr_w2", "match_addr_w2"),
    ("post_addr", "k_post_addr", "k_post_addr", "match_post_addr"),
    ("post_name4", "k_post_name4", "k_post_name4", "match_post_name4"),
]
FLAGS = list(dict.fromkeys(r[3] for r in RULES))
KEYS = list(dict.fromkeys(k for r in RULES for k in r[1:3]))


def keyed(records: DataFrame) -> DataFrame:
    """One row per entity with all rule keys; entities delivered twice, with equal normalised fields, are taken once.

    Only the id and the normalised fields travel to the deduplication, a hash aggregate; keys are derived after it.
    """
    one = records.select("entity_id", "country_norm", "name_norm", "address_norm").distinct()
    return K.with_selective_keys(K.with_block_keys(one))


def rule_pairs(a: DataFrame, b: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Distinct pairs of one rule: one shuffled equi-join on the key; null keys are dropped before the shuffle.

    Nothing is shuffled after the join. Two entities meet more than once only where both have several keys (versions of
    one entity); those carry their keys along, and the pair is taken under the least that both have.
    """
    def side(t: DataFrame, key: str, id_name: str, several: str) -> DataFrame:
        keys = t.filter(F.col(key).isNotNull()).groupBy("entity_id").agg(F.collect_set(key).alias("keys"))
        return keys.select(F.col("entity_id").alias(id_name), F.when(F.size("keys") > 1, F.col("keys")).alias(several), F.explode("keys").alias("key"))

    l, r = side(a, left_key, "s1_id", "_l"), side(b, right_key, "cand_id", "_r")
    least = F.col("key") == F.array_min(F.array_intersect("_l", "_r"))
    return l.join(r, "key").filter(F.col("_l").isNull() | F.col("_r").isNull() | least).select("s1_id", "cand_id")


def versions(t: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The keyed rows of entities with one row, and those of entities with several (None where there are none)."""
    several = materialize(t.groupBy("entity_id").count().filter("count > 1").select("entity_id"), "versions")
    if several.isEmpty():
        return t, None
    return t.join(several, "entity_id", "left_anti"), t.join(several, "entity_id", "left_semi")


def _long(t: DataFrame, side: int, id_name: str, present: str) -> DataFrame:
    """(id, presence bits of all rules, rule, key): one row per rule whose key is present."""
    rules = F.array(*[F.struct(F.lit(i).alias("rule"), F.col(r[side]).alias("key")) for i, r in enumerate(RULES)])
    bits = sum((F.when(F.col(r[side]).isNotNull(), 1 << i).otherwise(0) for i, r in enumerate(RULES)), F.lit(0))
    return (
        t.select(F.col("entity_id").alias(id_name), bits.alias(present), F.explode(F.filter(rules, lambda x: x["key"].isNotNull())).alias("x"))
        .select(id_name, present, "x.rule", "x.key")
    )


def joined_once(a: DataFrame, b: DataFrame, left: dict[str, Column] | None = None, right: dict[str, Column] | None = None) -> DataFrame:
    """Every pair of records that share the key of a rule, once, with their keys as hashes ``l_*`` and ``r_*``.

    The rules are unpivoted, so one equi-join on (rule, key) replaces an OR of equalities, which would plan as a
    product. All keys of both records travel along as hashes, so a pair is taken under the first rule that fires only, and
    pairs are never shuffled. Ids must be unique on either side. ``left`` and ``right`` are more columns to carry.
    """
    def side(t: DataFrame, i: int, id_name: str, pre: str, more: dict[str, Column] | None) -> DataFrame:
        rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(r[i]).alias("key")) for n, r in enumerate(RULES)])
        hashes = [F.when(F.col(k).isNotNull(), F.xxhash64(k)).alias(f"{pre}{k}") for k in dict.fromkeys(r[i] for r in RULES)]
        each = F.explode(F.filter(rules, lambda x: x["key"].isNotNull())).alias("x")
        out = t.select(F.col("entity_id").alias(id_name), *hashes, *[c.alias(n) for n, c in (more or {}).items()], each)
        return out.select("*", "x.rule", "x.key").drop("x")

    pairs = side(a, 1, "s1_id", "l_", left).join(side(b, 2, "cand_id", "r_", right), ["rule", "key"])
    fired = reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.col(f"l_{l}") == F.col(f"r_{r}"), 1 << i).otherwise(0) for i, (_, l, r, _) in enumerate(RULES)])
    return pairs.filter(fired.bitwiseAND(F.expr("shiftleft(1, rule) - 1")) == 0).drop("rule", "key")


def generate_pairs(a: DataFrame, b: DataFrame, source: str, null_flags: bool = True) -> DataFrame:
    """All distinct pairs that share the key of at least one rule, with source and flags.

    With ``null_flags`` a rule is FALSE where the left key is null, NULL where only the right one is, else whether it
    fired; without, whether it fired. A flag of two rules is their disjunction. Pairs of entities with several versions
    are merged over their versions; all others leave the join as they are. Hot keys are split by AQE; the pairs of a key
    are all wanted, so ``measure.pair_volume`` should be asked for their number first.
    """
    (a1, a2), (b1, b2) = versions(a), versions(b)

    def fired(l: str, r: str) -> Column:
        hit = F.col(f"l_{l}") == F.col(f"r_{r}")
        return F.when(F.col(f"l_{l}").isNull(), False).otherwise(hit) if null_flags else F.coalesce(hit, F.lit(False))

    flags = [reduce(lambda x, y: x | y, [fired(l, r) for _, l, r, g in RULES if g == f]).alias(f) for f in FLAGS]
    out = joined_once(a1, b1).select("s1_id", "cand_id", F.lit(source).alias("cand_source"), *flags)
    for several in merged_pairs((a1, a2), (b1, b2), source, null_flags):
        out = out.unionByName(several)
    return out


def merged_pairs(a: tuple[DataFrame, DataFrame | None], b: tuple[DataFrame, DataFrame | None], source: str, null_flags: bool = True) -> list[DataFrame]:
    """Pairs of which a side has several versions, as of ``versions``, merged over their versions; no table where there are none."""
    (a1, a2), (b1, b2) = a, b
    out = []
    if a2 is not None:
        out.append(_merged(a2, b1 if b2 is None else b1.unionByName(b2), source, null_flags))
    if b2 is not None:
        out.append(_merged(a1, b2, source, null_flags))
    return out


def _merged(a: DataFrame, b: DataFrame, source: str, null_flags: bool) -> DataFrame:
    """Which keys each record has travels along as bits, so flags follow from bits without reading a record again."""
    left, right = ("la", "lb") if null_flags else ("_la", "_lb")
    long_a, long_b = _long(a, 1, "s1_id", left), _long(b, 2, "cand_id", right)
    if not null_flags:
        long_a, long_b = long_a.drop(left), long_b.drop(right)
    aggs = [F.bit_or(F.expr("shiftleft(1, rule)")).alias("mask"), *([F.bit_or(left).alias(left), F.bit_or(right).alias(right)] if null_flags else [])]
    pairs = long_a.join(long_b, ["rule", "key"]).groupBy("s1_id", "cand_id").agg(*aggs)
    on = lambda bits, i: bits.bitwiseAND(F.lit(1 << i)) != 0

    def fired(i: int) -> Column:
        hit = on(F.col("mask"), i)
        return F.when(~on(F.col(left), i), False).when(~on(F.col(right), i), F.lit(None).cast("boolean")).otherwise(hit) if null_flags else hit

    flags = [reduce(lambda x, y: x | y, [fired(i) for i, r in enumerate(RULES) if r[3] == f]).alias(f) for f in FLAGS]
    return pairs.select("s1_id", "cand_id", F.lit(source).alias("cand_source"), *flags)


def packed_ids(s1: DataFrame) -> DataFrame:
    """The rows of ``pack`` without their lists, which no pair decides."""
    return s1.select(F.col("entity_id").alias("source1_entity_id")).distinct()


def pack(pairs: DataFrame, s1: DataFrame) -> DataFrame:
    """One row per left entity with its candidates, sorted and comma-joined; '' where there are none."""
    lists = pairs.groupBy("s1_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("cand_id"))).alias("ids"))
    return packed_ids(s1).join(lists, F.col("source1_entity_id") == F.col("s1_id"), "left").select(
        "source1_entity_id", F.coalesce("ids", F.lit("")).alias("candidate_entity_ids")
    )
