"""Scalar text functions: Column in, Column out, all inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a mark and as white space.
PUNCT = r"\p{Punct}+"  # ASCII marks only; typographic marks and other scripts stay
SPACE = r"[\t\n\f\r ]+"  # not the vertical tab, not the no-break space


def normalize_text(c: Column | str) -> Column:
    """Lower case, ``&`` as ``and``, runs of ASCII punctuation and of white space as one space, trimmed. Null gives ''."""
    x = F.lower(F.replace(F.coalesce(_col(c), F.lit("")), F.lit("&"), F.lit(" and ")))
    return F.trim(F.regexp_replace(F.regexp_replace(x, PUNCT, " "), SPACE, " "))


def normalize_country(c: Column | str) -> Column:
    """Trimmed of spaces and lower case. Null stays null."""
    return F.lower(F.trim(_col(c)))


def first_number(c: Column | str) -> Column:
    """First run of digits, '' where there is none."""
    return F.regexp_extract(_col(c), "[0-9]+", 0)


def postal(c: Column | str) -> Column:
    """First five or six digits in a row, without a word boundary; '' where there are none."""
    return F.regexp_extract(_col(c), "[0-9]{5,6}", 0)


def word(c: Column | str, n: int) -> Column:
    """The n-th blank-separated word, '' beyond the last."""
    return F.split_part(_col(c), F.lit(" "), F.lit(n))


def tokens(c: Column | str) -> Column:
    """Distinct blank-separated words."""
    return F.array_distinct(F.split(_col(c), " "))


def numbers(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_col(c), F.lit("([0-9]+)"), F.lit(1)))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
