"""Blocking keys as Column expressions. A key whose gate fails, or whose country is null, is null and never joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import text as X


def _join(*parts: Column) -> Column:
    """Null where any part is null."""
    out = [parts[0]]
    for p in parts[1:]:
        out += [F.lit("|"), p]
    return F.concat(*out)


def _cna() -> tuple[Column, Column, Column]:
    return F.col("country_norm"), F.col("name_norm"), F.col("address_norm")


def prefix_key(column: str, n: int) -> Column:
    """Country and the first n characters, for values of at least n characters."""
    return F.when(F.length(column) >= n, _join(F.col("country_norm"), F.substring(column, 1, n)))


def block_keys() -> dict[str, Column]:
    """The five keys that every record carries."""
    C, N, A = _cna()
    zip_code = X.postal(A)
    return {
        "block_name_exact": F.when(N != "", _join(C, N)),
        "block_address_exact": F.when(A != "", _join(C, A)),
        "block_name_prefix5": prefix_key("name_norm", 5),
        "block_address_prefix8": prefix_key("address_norm", 8),
        "block_postal": F.when(zip_code != "", _join(C, zip_code)),
    }


def parts() -> dict[str, Column]:
    _, N, A = _cna()
    return {"addr_num": X.first_number(A), "w1": X.word(N, 1), "w2": X.word(N, 2)}


def selective_keys() -> dict[str, Column]:
    """The five composite keys; they read addr_num, w1, w2 and block_postal."""
    C, N, _ = _cna()
    num, w1, w2, post = (F.col(x) for x in ("addr_num", "w1", "w2", "block_postal"))
    has_num = num != ""
    return {
        "k_addr_name5": F.when(has_num & (F.length(N) >= 5), _join(C, num, F.substring(N, 1, 5))),
        "k_addr_w1": F.when(has_num & (F.length(w1) >= 4), _join(C, num, w1)),
        "k_addr_w2": F.when(has_num & (F.length(w2) >= 4), _join(C, num, w2)),
        "k_post_addr": F.when(post.isNotNull() & has_num, _join(post, num)),
        "k_post_name4": F.when(post.isNotNull() & (F.length(N) >= 4), _join(post, F.substring(N, 1, 4))),
    }


def normalized(raw: DataFrame) -> DataFrame:
    """Raw source rows with country_norm, name_norm and address_norm. A narrow projection."""
    return raw.withColumns({
        "country_norm": X.normalize_country("country"),
        "name_norm": X.normalize_text("business_name"),
        "address_norm": X.normalize_text("business_address"),
    })


def with_block_keys(df: DataFrame) -> DataFrame:
    return df.withColumns(block_keys())


def with_selective_keys(df: DataFrame) -> DataFrame:
    """Each part is computed once and then reused by the keys."""
    return df.withColumns(parts()).withColumns(selective_keys())
