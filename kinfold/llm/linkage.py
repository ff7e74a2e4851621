"""Matching entities across sources without a shared key: soft logic, solved by distributed alternating directions.

Ground atoms are pairs of an S1 record and a *profile* of the other sources: all records there with the same group of name
spellings and the same building. Records of one profile meet the same S1 records with the same evidence, so they share one
value (the problem is lifted: solved once for a profile, whatever its number of records). Weighted rules, as hinges:

* similarity - names, buildings and how many organisations share them give each pair a target value (squared hinges);
* exclusivity - the values of a profile sum to at most 1, since a business has one S1 record (linear hinge);
* transitivity - profiles of one S1 record at one building draw each other's values together (squared hinges).

The sum is convex. Each rule keeps a local copy of the values it reads; one step solves all copies in closed form, averages
them, and updates the multipliers (ADMM). Copies of one rule are summed by a window over its key, so a step is two
shuffles of the contested pairs; pairs whose profile has one S1 record and no neighbour have a closed form and take no
part. The value of a pair is its confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm.addresses import buildings
from kinfold.llm.names import name_groups
from kinfold.session import materialize, spread

SIMILARITY, EXCLUSIVITY, TRANSITIVITY, RHO = 1.0, 4.0, 0.5, 1.0


def _signed(*columns: str, to: str = "k") -> list[Column]:
    return [F.xxhash64(*columns).alias(f"{to}0"), F.hash(*columns).alias(f"{to}1")]


def profiled(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``entity_id, src, root, building``, an entity's name group and building, null where it has none; and the forms of
    the groups: ``root, context, forms``.

    An entity delivered again as it was counts once; one delivered with another name or address has a row for each.
    Extra columns are ignored.
    """
    # Texts meet their groups by 96-bit signatures, and only those are carried on once a text is read.
    names = records.filter("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n")).select("*", *_signed("name", to="n"))
    places = records.filter("address <> ''").groupBy("address", "country").agg(F.count(F.lit(1)).alias("n")).select("*", *_signed("address", "country", to="a"))
    groups = materialize(name_groups(names, keys=("n0", "n1")), "name_groups")
    at = buildings(places, keys=("a0", "a1"))
    out = records.select("entity_id", "src", *_signed("name", to="n"), *_signed("address", "country", to="a"))
    out = out.join(spread(groups.select("n0", "n1", "root")), ["n0", "n1"], "left").join(spread(at), ["a0", "a1"], "left")
    forms = groups.filter("node = root").groupBy("root").agg(F.first("context").alias("context"), F.first("forms").alias("forms"))
    return materialize(out.select("entity_id", "src", "root", "building").distinct(), "profiled"), forms


def candidates(entities: DataFrame, forms: DataFrame) -> DataFrame:
    """Pairs ``s1_id, root, building`` with evidence ``e`` in [0, 1]; ``root`` and ``building`` name the profile."""
    s1 = entities.filter("src = 1").select(F.col("entity_id").alias("s1_id"), F.col("root").alias("s_root"), F.col("building").alias("s_building"))
    profiles = entities.filter("src > 1 AND (root IS NOT NULL OR building IS NOT NULL)").select("root", "building").distinct()
    profiles = materialize(profiles, "profiles")
    # A name with several S1 records is a chain: there the building decides.
    per_root = s1.filter("s_root IS NOT NULL").select("s_root", "s1_id").distinct().groupBy("s_root").agg(F.count(F.lit(1)).alias("n_s1"))
    # An S1 record without a name at a building of just one organisation that no S1 record names stands for that one.
    homes = profiles.filter("root IS NOT NULL AND building IS NOT NULL").select(F.col("root").alias("s_root"), F.col("building").alias("s_building"))
    lone = s1.filter("s_root IS NULL AND s_building IS NOT NULL").groupBy("s_building").agg(F.min("s1_id").alias("s1_id"), F.count(F.lit(1)).alias("c")).filter("c = 1")
    unnamed = homes.join(lone.select("s_building"), "s_building", "left_semi").join(spread(per_root), "s_root", "left_anti").groupBy("s_building").agg(F.min("s_root").alias("r0"), F.max("s_root").alias("r1")).filter("r0 = r1")
    once = lone.join(unnamed, "s_building").groupBy(F.col("r0").alias("adopted")).agg(F.min("s1_id").alias("s1_id"), F.count(F.lit(1)).alias("c")).filter("c = 1").select("s1_id", "adopted")
    s1 = s1.join(spread(per_root), "s_root", "left").join(once, "s1_id", "left")
    s1 = s1.withColumns({"s_root": F.coalesce("s_root", "adopted"), "n_s1": F.coalesce("n_s1", F.when(F.col("adopted").isNotNull(), 1))})
    s1 = materialize(s1, "s1")
    by_name = s1.filter("n_s1 = 1").join(spread(profiles), F.col("s_root") == F.col("root"))
    by_place = s1.join(spread(profiles), F.col("s_building") == F.col("building")).filter("NOT (n_s1 <=> 1 AND s_root <=> root)")
    cols = ["s1_id", "s_root", "s_building", "adopted", "root", "building"]
    pairs = materialize(by_name.select(*cols).unionByName(by_place.select(*cols)), "pairs")
    same_name, same_place = F.col("s_root") == F.col("root"), F.col("s_building") == F.col("building")
    sure = pairs.filter(F.coalesce(same_name, F.lit(False))).select("s1_id", "root", "building", F.when(F.col("adopted").isNotNull(), 0.75).when(same_place, 0.98).otherwise(0.9).alias("e"))
    # One side has no name: the fewer organisations share the building, the likelier is each.
    nameless = pairs.filter("s_root IS NULL OR root IS NULL")
    homes = entities.select("building", "root").join(spread(nameless.select("building").distinct()), "building", "left_semi").distinct()
    orgs = homes.groupBy("building").agg(F.count("root").alias("orgs"))
    alone = nameless.join(spread(orgs), "building").select("s1_id", "root", "building", F.when(F.col("orgs") <= 1, 0.8).otherwise(F.lit(0.4) / F.col("orgs")).alias("e"))
    # Two names at one building: own words alike, in the closest of their orders; another line of business needs more.
    side = lambda name: forms.select(F.col("root").alias(name), F.struct("context", "forms").alias(f"{name}_"))
    two = pairs.filter("s_root <> root").select("s1_id", "s_root", "root", "building").join(spread(side("s_root")), "s_root").join(spread(side("root")), "root")
    ratio = lambda a, b: F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    own = F.array_max(F.flatten(F.transform("s_root_.forms", lambda a: F.transform("root_.forms", lambda b: ratio(a, b)))))
    alike = F.when(F.col("s_root_.context") == F.col("root_.context"), (own - 0.4) * 3).otherwise((own - 0.55) * 2)
    other = two.select("s1_id", "root", "building", F.greatest(F.lit(0.02), F.least(F.lit(0.9), alike)).alias("e"))
    return sure.unionByName(alone).unionByName(other)


def _excluded(v: Column, key: str) -> Column:
    """Proximal step of the exclusivity hinge on the values that share ``key``."""
    w = W.partitionBy(key)
    over, n = F.sum(v).over(w) - 1, F.count(F.lit(1)).over(w)
    return v - F.when(over <= 0, 0.0).when(over >= n * EXCLUSIVITY / RHO, EXCLUSIVITY / RHO).otherwise(over / n)


def _drawn(v: Column, key: str) -> Column:
    """Proximal step of the transitivity hinges on the values that share ``key``."""
    return (TRANSITIVITY * F.avg(v).over(W.partitionBy(key)) + RHO * v) / (TRANSITIVITY + RHO)


def solve(pairs: DataFrame, steps: int = 64, tolerance: float = 0.01) -> DataFrame:
    """Adds ``confidence`` to pairs (``s1_id, root, building, e``), one row per pair.

    Ends when no value has moved by ``tolerance`` over four steps, or after ``steps``.
    """
    keyed = pairs.groupBy("s1_id", "root", "building").agg(F.max("e").alias("e"))
    profile = F.xxhash64(F.coalesce("root", F.lit(0)), F.coalesce("building", F.lit(0)))
    group = F.xxhash64("s1_id", F.coalesce("building", F.lit(0)))
    keyed = keyed.select("*", profile.alias("p"), group.alias("g"))
    keyed = keyed.withColumn("rivals", F.count(F.lit(1)).over(W.partitionBy("p"))).withColumn("contested", F.max(F.col("rivals") > 1).over(W.partitionBy("g")))
    keyed = materialize(keyed, "atoms")
    e = F.col("e")
    free = keyed.filter("NOT contested")
    mean = F.avg(e).over(W.partitionBy("g"))
    free = free.withColumn("confidence", (SIMILARITY * e + TRANSITIVITY * mean) / (SIMILARITY + TRANSITIVITY))
    x = keyed.filter("contested").withColumns({"z": e, "was": e, "u1": F.lit(0.0), "u2": F.lit(0.0), "u3": F.lit(0.0)})
    z, u1, u2, u3 = (F.col(c) for c in ("z", "u1", "u2", "u3"))
    for step in range(steps):
        x = x.withColumns({"x1": (SIMILARITY * e + RHO * (z - u1)) / (SIMILARITY + RHO), "v2": z - u2, "v3": z - u3})
        x = x.withColumn("x2", _excluded(F.col("v2"), "p"))
        x = x.withColumn("x3", _drawn(F.col("v3"), "g"))
        copies = [(F.col("x1"), u1), (F.col("x2"), u2), (F.col("x3"), u3)]
        x = x.withColumn("z", F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((a + b for a, b in copies), F.lit(0.0)) / 3)))
        x = x.withColumns({f"u{i + 1}": b + a - z for i, (a, b) in enumerate(copies)}).drop("x1", "x2", "x3", "v2", "v3")
        if step % 4 == 3:
            x = materialize(x, "admm")
            if (x.agg(F.max(F.abs(z - F.col("was")))).first()[0] or 0.0) < tolerance:
                break
            x = x.withColumn("was", z)
    cols = ["s1_id", "root", "building", "confidence"]
    return free.select(*cols).unionByName(x.withColumnRenamed("z", "confidence").select(*cols))


def link(records: DataFrame, known: DataFrame | None = None, at_least: float = 0.5) -> DataFrame:
    """Matches ``s1_id, cand_id, confidence`` of S1 records with records of the other sources.

    ``records`` has ``entity_id, name, address, country, src``; ``known`` may give true links ``s1_id, cand_id``: their
    profiles are evidence for their S1 record and, through exclusivity, against all others. Records with neither a
    readable name nor a building match nothing. Null names and addresses count as missing; an empty table gives no rows.
    """
    records = records.withColumns({"name": F.coalesce("name", F.lit("")), "address": F.coalesce("address", F.lit(""))})
    entities, forms = profiled(records)
    pairs = candidates(entities, forms)
    if known is not None:
        at = entities.filter("src > 1").select(F.col("entity_id").alias("cand_id"), "root", "building").filter("root IS NOT NULL OR building IS NOT NULL")
        seen = known.join(spread(at), "cand_id").select("s1_id", "root", "building", F.lit(0.99).alias("e")).distinct()
        labelled = known.select("s1_id").distinct().withColumn("labelled", F.lit(True))
        pairs = pairs.join(labelled, "s1_id", "left").withColumn("e", F.when(F.col("labelled"), F.lit(0.02)).otherwise(F.col("e"))).drop("labelled").unionByName(seen)
    solved = solve(pairs).filter(F.col("confidence") >= at_least)
    rest = entities.filter("src > 1").select(F.col("entity_id").alias("cand_id"), F.col("root").alias("r_"), F.col("building").alias("b_"))
    on = F.col("root").eqNullSafe(F.col("r_")) & F.col("building").eqNullSafe(F.col("b_"))
    return solved.join(spread(rest), on).select("s1_id", "cand_id", "confidence")
