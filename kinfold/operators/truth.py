"""Packed ground truth: lists of ids as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.segment import segment

#: Fixed value. General form of an id.
ID_FORM = "S[0-9]+-[0-9]+"


def read_links(truth: DataFrame, ids: DataFrame, left: str = "source1_entity_id", packed: str = "matched_entity_ids") -> DataFrame:
    """Links ``s1_id, cand_id``: every id of the packed lists, however they are delimited or quoted, repeats kept once.

    ``ids`` (one column) are the ids of all records; ids without a record are links too. Null and id-free lists give none.
    """
    found = segment(truth, [left], packed, ids, ID_FORM)
    return found.select(F.col(left).alias("s1_id"), F.col("value").alias("cand_id")).distinct()


def parse_links(truth: DataFrame, left: str = "source1_entity_id", packed: str = "matched_entity_ids") -> DataFrame:
    """Links ``s1_id, cand_id`` of well-formed lists: split at commas, trimmed, empty pieces dropped, repeats kept once.

    For exploration only: where lists have other delimiters or quotes the pieces are no ids; ``read_links`` reads those.
    """
    pieces = F.explode(F.split(packed, ",", -1))
    return (
        truth.select(F.col(left).alias("s1_id"), pieces.alias("raw"))
        .select("s1_id", F.trim("raw").alias("cand_id"))
        .filter(F.col("cand_id") != "")
        .distinct()
    )


def with_source(links: DataFrame, s2: DataFrame, s3: DataFrame) -> DataFrame:
    """Adds ``target_source``: S2, S3 or UNKNOWN for links that point at no record. One join on the tagged ids."""
    ids = s2.select(F.col("entity_id").alias("cand_id"), F.lit("S2").alias("src")).unionByName(
        s3.select(F.col("entity_id").alias("cand_id"), F.lit("S3").alias("src"))
    )
    return links.join(ids, "cand_id", "left").select(
        "s1_id", "cand_id", F.coalesce("src", F.lit("UNKNOWN")).alias("target_source")
    )


def link_profile(truth: DataFrame, packed: str = "matched_entity_ids") -> DataFrame:
    """Histogram of list lengths: raw comma pieces, nothing trimmed; null or empty lists have 0."""
    n = F.when(F.coalesce(packed, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(packed, ",", -1)))
    return truth.select(n.cast("long").alias("n_matches")).groupBy("n_matches").agg(F.count(F.lit(1)).alias("rows"))


def source_tally(truth: DataFrame, packed: str = "matched_entity_ids") -> DataFrame:
    """Rows whose list names both sources, one of them, or none."""
    a = F.split(F.coalesce(packed, F.lit("")), ",", -1)
    has = lambda p: F.exists(a, lambda x: F.startswith(x, F.lit(p)))
    t = truth.select(has("S2-").alias("s2"), has("S3-").alias("s3"))
    c = lambda p: F.count_if(p)
    s2, s3 = F.col("s2"), F.col("s3")
    return t.agg(c(s2 & s3).alias("both"), c(s2 & ~s3).alias("only_s2"), c(~s2 & s3).alias("only_s3"), c(~s2 & ~s3).alias("none"))
