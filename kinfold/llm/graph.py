"""Groups of near-alike items: each joins its heaviest neighbour, and the chains of joins are followed to their ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.session import materialize, spread


def near(a: Column, b: Column) -> Column:
    """At most one edit or transposition, or two edits in texts of eight and more characters."""
    two = F.levenshtein(a, b, 2)
    letters = lambda x: F.sort_array(F.split(x, ""))
    close = (two >= 0) & (two <= 1) | (two == 2) & ((F.least(F.length(a), F.length(b)) >= 8) | (letters(a) == letters(b)))
    return (a == b) | close


def usual(nodes: DataFrame) -> Column:
    """The median ``weight`` of nodes, as a scalar: what one spelling weighs in this corpus."""
    return nodes.agg(F.percentile("weight", F.lit(0.5)).alias("usual")).scalar()


def much_rarer(a: Column, b: Column, usual: Column) -> Column:
    """Whether of two weights one is so small beside the other that its spelling can be an error.

    That is a quarter of the other at most; a weight of up to three usual ones says nothing against an error. Both are
    relative, so counting every record ten times changes nothing.
    """
    light = F.least(a, b)
    return (light <= 3 * usual) | (4 * light <= F.greatest(a, b))


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, root`` for ``nodes`` (id, weight) and undirected ``edges`` (a, b), written to the shared folder.

    A node joins the heaviest of its neighbours and itself, of equal weight the smaller id. That order is total, so there
    are no cycles, and hubs of low weight cannot chain two heavy groups together as connected components would. Chains
    are halved by pointer jumping until none is left; each round is one equi-join of the nodes below a root, and nothing is
    collected.
    """
    # Both directions in one pass: a union would make the edges twice.
    way = lambda x, y: F.struct(F.col(x).alias("id"), F.col(y).alias("other"))
    both = edges.select(F.inline(F.array(way("a", "b"), way("b", "a"))))
    weights = nodes.select(F.col("id").alias("other"), "weight")
    best = F.max(F.struct(F.col("weight"), (-F.col("other")).alias("neg")))
    heaviest = both.join(spread(weights), "other").groupBy("id").agg(best.alias("m"))
    # A node that is heavier than its neighbours, or has none, is its own root and moves no further.
    own = F.struct(F.col("weight"), (-F.col("id")).alias("neg"))
    up = nodes.join(spread(heaviest), "id", "left").select("id", F.when(F.col("m") > own, -F.col("m.neg")).otherwise(F.col("id")).alias("root"))
    parents = materialize(up, "parents")
    joined, tops = parents.filter("id <> root"), parents.filter("id = root")
    while True:
        above = joined.select(F.col("id").alias("root"), F.col("root").alias("upper"))
        moved = joined.join(spread(above), "root", "left").select("id", F.coalesce("upper", "root").alias("root"), F.col("upper").isNotNull().alias("moved"))
        moved = materialize(moved, "parents")
        joined = moved.select("id", "root")
        if moved.filter("moved").isEmpty():
            return tops.unionByName(joined)
