"""Pair features over two normalised records, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions import text as X


def edit_similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length; two empty texts give 1."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)


def overlap(a: Column, b: Column) -> Column:
    """Number of distinct common elements of two arrays."""
    return F.size(F.array_intersect(a, b)).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    """Common over all distinct elements; 0 where there is none."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def length_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.least(F.length(a), F.length(b)) / longest)


def word_set(c: Column) -> Column:
    """Distinct words without the empty one."""
    return F.filter(X.tokens(c), lambda t: t != "")
