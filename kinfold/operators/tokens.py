"""Shared and rare name words as blocking rules, evaluated on true links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import text as X

#: Words that link nothing, of the plain rule and of the rare-word rule.
STOP = ["private", "limited", "ltd", "pvt", "llc", "inc", "corp", "corporation", "company", "co", "llp"]
STOP_RARE = ["private", "limited", "ltd", "pvt", "llc", "inc", "corp", "corporation", "company", "store", "market", "restaurant", "hotel", "medical", "hospital"]


def useful(words: Column, stop: list[str]) -> Column:
    """Words of at least four characters that are no stop words."""
    return F.filter(words, lambda t: (F.length(t) >= 4) & ~t.isin(stop))


def shares_token(a: Column, b: Column) -> Column:
    """Whether two names share a useful word; array functions only, no join."""
    return F.size(useful(F.array_intersect(X.tokens(a), X.tokens(b)), STOP)) > 0


def token_frequency(tables: list[DataFrame]) -> DataFrame:
    """Number of distinct entities by name word, over all tables."""
    t = reduce(DataFrame.unionByName, [x.select("entity_id", "name_norm") for x in tables])
    words = t.select("entity_id", F.explode(X.tokens(F.col("name_norm"))).alias("token")).filter(F.col("token") != "")
    return words.distinct().groupBy("token").agg(F.count(F.lit(1)).alias("frequency"))


def rare_token_hits(evaluated: DataFrame, frequency: DataFrame, caps: list[int]) -> DataFrame:
    """True links that share a useful word of frequency at most T, for each T: words of links only are looked up."""
    common = useful(F.array_intersect(X.tokens(F.col("a_name_norm")), X.tokens(F.col("b_name_norm"))), STOP_RARE)
    per_link = (
        evaluated.select("s1_id", "cand_id", F.explode(common).alias("token")).join(frequency, "token")
        .groupBy("s1_id", "cand_id").agg(F.min("frequency").alias("rarest"))
    )
    hits = per_link.agg(*[F.count_if(F.col("rarest") <= t).alias(f"t{t}") for t in caps])
    return hits.select(F.inline(F.array(*[F.struct(F.lit(t).alias("cap"), F.col(f"t{t}").alias("hits")) for t in caps])))
