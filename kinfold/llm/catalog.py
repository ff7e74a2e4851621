"""The registered queries of the training-data operators, and SQL where it can give the same rows on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import addresses, encode, linkage, mixing, names, topn, truncation
from kinfold.operators.segment import segment
from kinfold.operators.truth import ID_FORM

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """``entity_id, name, address, country, src`` of the three sources."""
    one = lambda n: _t(spark, d, f"train_s{n}").select("entity_id", F.col("name_norm").alias("name"), F.col("address_norm").alias("address"), F.col("country_norm").alias("country"), F.lit(n).alias("src"))
    return one(1).unionByName(one(2)).unionByName(one(3))


# ---------------------------------------------------------------- problem 3: variant spellings of names

@query("p3_found")
def p3_found(spark, d):
    """Pairs of different names of one organisation."""
    return names.same_organisation(_records(spark, d).select("name", F.lit(1).alias("n")))


@query("p3_scored")
def p3_scored(spark, d):
    """The pairs with a score by the rarity of their rewritings."""
    return names.same_organisation(_records(spark, d).select("name", F.lit(1).alias("n")), scored=True)


# ---------------------------------------------------------------- problem 4: same postal address written differently

@query("p4_found")
def p4_found(spark, d):
    """Pairs of records at one building with different addresses."""
    return addresses.same_building(_records(spark, d))


# ---------------------------------------------------------------- problem 2: top N items within every group

_TOP = """SELECT s1_id, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) AS INTEGER) AS rank, cand_id, score FROM
 (SELECT s1_id, cand_id, max(score) AS score FROM pairs_s2 WHERE score IS NOT NULL AND NOT isnan(score) AND cand_id IS NOT NULL GROUP BY ALL) QUALIFY rank <= 5"""


@query("p2_found", f"SELECT s1_id, cand_id FROM ({_TOP})")
def p2_found(spark, d):
    """The five best-scored candidates of every S1 record."""
    return topn.top_n(_t(spark, d, "pairs_s2"), "s1_id", "cand_id", "score", 5).select("s1_id", "cand_id")


@query("p2_ranked", _TOP)
def p2_ranked(spark, d):
    """The five best-scored candidates of every S1 record with rank and score."""
    return topn.top_n(_t(spark, d, "pairs_s2"), "s1_id", "cand_id", "score", 5)


# ---------------------------------------------------------------- problem 6: matching entities without keys

def _known(spark: SparkSession, d: str) -> DataFrame:
    """The labelled links, with the ids of the packed lists read whole.

    Ids of general form are found as such, so only the irregular ones are given as known values.
    """
    ids = _records(spark, d).select("entity_id").filter(~F.col("entity_id").rlike(f"^{ID_FORM}$"))
    lists = segment(_t(spark, d, "train_matches"), ["source1_entity_id"], "matched_entity_ids", ids, ID_FORM)
    return lists.select(F.col("source1_entity_id").alias("s1_id"), F.col("value").alias("cand_id")).distinct()


def _linked(spark: SparkSession, d: str) -> DataFrame:
    labelled = _t(spark, d, "train_matches").select(F.col("source1_entity_id").alias("s1_id")).distinct()
    return linkage.link(_records(spark, d), _known(spark, d)).join(labelled, "s1_id", "left_anti")


@query("p6_found")
def p6_found(spark, d):
    """Matches of the unlabelled S1 records."""
    return _linked(spark, d).select("s1_id", "cand_id").distinct()


@query("p6_confidence")
def p6_confidence(spark, d):
    """Matches of the unlabelled S1 records with their confidence."""
    return _linked(spark, d)


# ---------------------------------------------------------------- problem 7: encoding of the whole corpus

@query("p7_ids")
def p7_ids(spark, d):
    """Token ids of every document by byte_bpe_50k."""
    return encode.encode(_t(spark, d, "documents"))


@query("p7_decoded", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p7_decoded(spark, d):
    """Every document encoded and decoded again."""
    return encode.decode(p7_ids(spark, d))


# ---------------------------------------------------------------- problem 8: mixing sources to target weights

@query("p8_mix")
def p8_mix(spark, d):
    """The documents of the mix with their number of copies."""
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


@query("p8_shares")
def p8_shares(spark, d):
    """Actual shares of the mix by source."""
    return mixing.shares(p8_mix(spark, d), _t(spark, d, "mix_targets"))


@query("p8_shares_soft")
def p8_shares_soft(spark, d):
    """Actual shares when documents without a source may be used once, by their posterior."""
    return mixing.shares(mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_targets"), unlabelled_repeats=1), _t(spark, d, "mix_targets"))


@query("p8_holdout")
def p8_holdout(spark, d):
    """Held-out accuracy of the source classifier."""
    domains = sorted(r["source"] for r in _t(spark, d, "mix_targets").filter(F.col("source").isNotNull()).collect())
    return mixing.holdout(_t(spark, d, "documents"), domains)


# ---------------------------------------------------------------- problem 9: text cut off by field limits

@query("p9_found")
def p9_found(spark, d):
    """Documents that were cut off before their end."""
    return truncation.truncated(_t(spark, d, "documents")).filter("cut").select("doc_id").distinct()


@query("p9_rates")
def p9_rates(spark, d):
    """How often each source cuts its documents off."""
    return truncation.rates(truncation.truncated(_t(spark, d, "documents")))


@query("p9_paths")
def p9_paths(spark, d):
    """Cut documents by the kind of value that showed it."""
    return truncation.truncated(_t(spark, d, "documents")).filter("cut").groupBy("path").agg(F.count(F.lit(1)).alias("n_cut"))
