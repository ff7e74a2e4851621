"""Pair features, labels, splits, macro F0.5 and the checks of a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import similarity as M
from kinfold.functions import text as X


def parts(i: int) -> dict[str, Column]:
    """What features need of one record, named by its side 1 or 2: taken apart once for a record, not for each of its pairs."""
    n, a = F.col("name_norm"), F.col("address_norm")
    words = F.filter(M.word_set(a), lambda x: ~x.rlike("^[0-9]+$"))
    return {f"n{i}": n, f"t{i}": M.word_set(n), f"num{i}": X.first_number(a), f"p{i}": X.postal(a), f"d{i}": X.numbers(a), f"w{i}": words}


def with_features(pairs: DataFrame, *more: str) -> DataFrame:
    """Name, address and source features of pairs that carry the ``parts`` of both records, and columns ``more``. A projection."""
    n1, n2, num1, num2, p1, p2 = (F.col(x) for x in ("n1", "n2", "num1", "num2", "p1", "p2"))
    both = F.col("name_overlap")
    union = F.size("t1") + F.size("t2") - both
    return pairs.withColumn("name_overlap", M.overlap(F.col("t1"), F.col("t2"))).select(
        "s1_id", "cand_id", "cand_source",
        M.edit_similarity(n1, n2).alias("name_similarity"), F.when(union == 0, F.lit(0.0)).otherwise(both / union).alias("name_jaccard"), both,
        M.length_ratio(n1, n2).alias("name_length_ratio"), ((n1 != "") & (n2 != "") & (F.contains(n1, n2) | F.contains(n2, n1))).alias("name_contained"),
        ((num1 != "") & (num1 == num2)).alias("number_match"), ((p1 != "") & (p1 == p2)).alias("postal_match"),
        M.overlap(F.col("d1"), F.col("d2")).alias("numbers_overlap"), M.overlap(F.col("w1"), F.col("w2")).alias("street_overlap"), *more,
    )


def pair_features(pairs: DataFrame, s1: DataFrame, cand: DataFrame) -> DataFrame:
    """``with_features`` of pairs given by ids; two id joins and projections."""
    side = lambda t, id_name, i: t.select(F.col("entity_id").alias(id_name), *[c.alias(n) for n, c in parts(i).items()])
    return with_features(pairs.join(side(s1, "s1_id", 1), "s1_id").join(side(cand, "cand_id", 2), "cand_id"))


def agreeing_rules(pairs: DataFrame, flags: list[str]) -> DataFrame:
    """Number of true flags of each pair."""
    n = sum((F.when(F.col(f), 1).otherwise(0) for f in flags), F.lit(0))
    return pairs.select("s1_id", "cand_id", n.cast("long").alias("agreeing"))


def label_pairs(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Positive where the pair is a true link, else a hard negative. A NaN ``score`` is no score: null."""
    if "score" in pairs.columns:
        pairs = pairs.withColumn("score", F.nullif("score", F.lit(float("nan"))))
    t = links.select("s1_id", "cand_id", F.lit(True).alias("is_match"))
    return pairs.join(t, ["s1_id", "cand_id"], "left").withColumn("is_match", F.coalesce("is_match", F.lit(False)))


def split_by_entity(df: DataFrame, id_column: str, folds: int) -> DataFrame:
    """Adds ``fold`` by a portable hash of the entity (32 bits of its MD5): all its rows fall into one fold, in any engine."""
    bits = F.conv(F.left(F.md5(id_column), F.lit(8)), 16, 10).cast("long")
    return df.withColumn("fold", F.pmod(bits, F.lit(folds)).cast("int"))


def macro_f05(predicted: DataFrame, links: DataFrame, s1: DataFrame) -> DataFrame:
    """Mean over all left entities of F0.5 = 1.25PR/(0.25P+R).

    No truth and no prediction scores 1, no truth and any prediction 0, P = R = 0 scores 0.
    """
    return mean_f05(_tallies(predicted, links), s1)


def _tallies(predicted: DataFrame, links: DataFrame) -> DataFrame:
    both = predicted.select("s1_id", "cand_id").distinct().withColumn("p", F.lit(1)).join(
        links.select("s1_id", "cand_id").distinct().withColumn("t", F.lit(1)), ["s1_id", "cand_id"], "full")
    return both.groupBy("s1_id").agg(F.count("p").alias("np"), F.count("t").alias("nt"), F.count(F.col("p") + F.col("t")).alias("tp"))


def mean_f05(per: DataFrame, s1: DataFrame) -> DataFrame:
    """``macro_f05`` from the numbers of predictions, links and hits of each left entity: ``s1_id, np, nt, tp``."""
    ids = s1.select(F.col("entity_id").alias("s1_id")).distinct()
    z = lambda c: F.coalesce(c, F.lit(0))
    np_, nt, tp = z("np"), z("nt"), z("tp")
    f = F.when((nt == 0) & (np_ == 0), 1.0).when(tp == 0, 0.0).otherwise(1.25 * tp / (0.25 * nt + np_))
    return ids.join(per, "s1_id", "left").agg(F.count(F.lit(1)).alias("entities"), F.avg(f).alias("macro_f05"))


def threshold_grid(scored: DataFrame, links: DataFrame, thresholds: list[float]) -> DataFrame:
    """Pairs, hits, precision and recall at each threshold, in one pass over the scored pairs."""
    df = label_pairs(scored, links)
    total = links.agg(F.count(F.lit(1)).alias("n")).scalar()
    aggs = [x for i, t in enumerate(thresholds) for x in (F.count_if(F.col("score") >= t).alias(f"p{i}"), F.count_if((F.col("score") >= t) & F.col("is_match")).alias(f"h{i}"))]
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"p{i}").alias("pairs"), F.col(f"h{i}").alias("hits")) for i, t in enumerate(thresholds)])
    g = df.agg(*aggs).select(F.inline(rows))
    return g.withColumns({"precision": F.col("hits") / F.nullif("pairs", F.lit(0)), "recall": F.col("hits") / F.nullif(total, F.lit(0))})


def validate(packed: DataFrame, s1: DataFrame, matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Row count against left entities, left entities missing or repeated, and matches that are no candidates."""
    ids = s1.select("entity_id").distinct()
    n = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    stray = matches.select("s1_id", "cand_id").distinct().join(candidates.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")
    per = packed.groupBy("source1_entity_id").agg(F.count(F.lit(1)).alias("c"))
    missing = ids.join(per, F.col("entity_id") == F.col("source1_entity_id"), "left_anti")
    return per.agg(F.sum("c").alias("rows"), F.count_if(F.col("c") > 1).alias("repeated")).select(
        "rows", n(ids).alias("entities"), "repeated", n(missing).alias("missing"), n(stray).alias("stray_matches"))
