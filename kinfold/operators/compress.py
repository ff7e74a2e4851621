"""Per-key results when a few keys hold most rows (value-frequency compression).

Rows are first counted by key *and* value. That shuffle hashes both, so the rows of a hot key spread over all tasks, and
map-side partial counts shrink them before they move. What is left of a key is one weighted row per distinct value; the
second aggregation works on those and again combines map-side, so a task gets at most one partial row per key and
upstream task. No task ever sees the raw rows of one key together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.session import materialize


def compress(df: DataFrame, keys: Sequence[str], value: str, freq: str = "freq") -> DataFrame:
    """One row per distinct (keys, value) with its number of rows as ``freq``.

    Null keys and null values are groups of their own; other columns are ignored; an empty table gives no rows.
    """
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(freq))


def key_sizes(compressed: DataFrame, keys: Sequence[str], freq: str = "freq") -> DataFrame:
    """Rows per key, from the weighted values."""
    return compressed.groupBy(*keys).agg(F.sum(freq).alias("n_rows"))


def key_profile(compressed: DataFrame, keys: Sequence[str], value: str, freq: str = "freq") -> DataFrame:
    """Exact per-key figures from weighted values: ``n_rows``, ``n_values``, ``mode``, ``mode_rows``.

    Null values count as rows but neither as a distinct value nor as a mode; a key with null values only has
    n_values 0 and a null mode. Of equally frequent values the smaller is the mode.
    """
    v = F.col(value)
    first = F.min(F.when(v.isNotNull(), F.struct((-F.col(freq)).alias("f"), v.alias("v"))))
    return (
        compressed.groupBy(*keys)
        .agg(F.sum(freq).alias("n_rows"), F.count(v).alias("n_values"), first.alias("m"))
        .select(*keys, "n_rows", "n_values", F.col("m.v").alias("mode"), (-F.col("m.f")).alias("mode_rows"))
    )


def key_percentiles(df: DataFrame, keys: Sequence[str], measure: str, at: Sequence[float]) -> DataFrame:
    """Exact interpolated percentiles ``p<100*at>`` of a numeric measure per key, from weighted values.

    The final state of a key is one counter per distinct measure, so this is for measures of bounded domain (lengths,
    counts, codes), whatever the number of rows. Null measures are left out; a key without any has null percentiles.
    """
    w = compress(df, keys, measure, "w_")
    ps = [F.percentile(F.col(measure), F.lit(p), F.col("w_")).alias(f"p{round(100 * p)}") for p in at]
    return w.groupBy(*keys).agg(*ps)


def heavy_keys(compressed: DataFrame, group: str, key: str, share: float, freq: str = "freq") -> DataFrame:
    """Keys that hold at least ``share`` of all rows of their group, rows without a key included in that total.

    The sizes are written once, for both inputs of the join; the totals side has one row per group.
    """
    sizes = materialize(key_sizes(compressed, [group, key], freq), "sizes")
    totals = sizes.groupBy(group).agg(F.sum("n_rows").alias("total_rows"))
    return (
        sizes.filter(F.col(key).isNotNull())
        .join(totals, group)
        .filter(F.col("n_rows") >= F.lit(share) * F.col("total_rows"))
        .select(group, key, "n_rows", "total_rows")
    )
