"""Top N items of every group by mergeable heaps of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that are put into heaps at once, and the most rows of heaps a task keeps before it hands them on and starts anew.
AT_ONCE = 200_000
MOST = 1_000_000


def _best(table, n: int):
    """The n best distinct items of each group of an Arrow table ``g, i, s``: highest score first, then the smaller item."""
    import numpy as np
    import pyarrow.compute as pc

    table = table.group_by(["g", "i"]).aggregate([("s", "max")]).rename_columns(["g", "i", "s"])
    groups = pc.dictionary_encode(table["g"].combine_chunks(), null_encoding="encode").indices
    table = table.append_column("c", groups)
    table = table.take(pc.sort_indices(table, [("c", "ascending"), ("s", "descending"), ("i", "ascending")]))
    c = np.asarray(table["c"])
    place = np.arange(len(c))
    first = np.maximum.accumulate(np.where(np.r_[True, c[1:] != c[:-1]], place, 0)) if len(c) else place
    return table.filter(place - first < n).drop_columns(["c"])


def heaps(rows: DataFrame, n: int) -> DataFrame:
    """``g, i, s``: rows of the n best distinct items of each group in each task; nothing is shuffled.

    A task keeps a heap of n distinct items, each with its best score, for every group it meets, and puts its rows into
    them some at a time; when the heaps of very many groups are too large together, it hands them on and starts anew.
    Merged with others by the same rule they give the exact result: an item of the overall best n, at its best score, is
    beaten by fewer than n items anywhere, so also in its task.
    """
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        kept, waiting, size = None, [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size >= AT_ONCE:
                new = pa.Table.from_batches(waiting)
                kept, waiting, size = _best(pa.concat_tables([kept, new]) if kept is not None else new, n), [], 0
                if kept.num_rows > MOST:
                    yield from kept.to_batches()
                    kept = None
        if waiting:
            new = pa.Table.from_batches(waiting)
            kept = _best(pa.concat_tables([kept, new]) if kept is not None else new, n)
        if kept is not None:
            yield from kept.to_batches()

    return rows.select("g", "i", "s").mapInArrow(run, rows.select("g", "i", "s").schema)


def top_n(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """``group, rank, item, score``: the n items of highest score of each group, of equal scores the smaller item first.

    Every task first makes its heaps (``heaps``), so at most n rows per group and task move, and no task ever holds a
    group; one shuffle by group brings the heaps together, where repeated items are merged and ranked.

    A repeated pair counts once, with its highest score. Rows with null or NaN score or null item do not count; a null
    group is a group of its own; 0.0 and -0.0 are equal; a group without countable rows has no row; other columns are
    ignored.
    """
    rows = (
        df.select(F.col(group).alias("g"), F.col(item).alias("i"), (F.col(score).cast("double") + F.lit(0.0)).alias("s"))
        .filter(F.col("s").isNotNull() & ~F.isnan("s") & F.col("i").isNotNull())
    )
    merged = heaps(rows, n).repartition("g").groupBy("g", "i").agg(F.max("s").alias("s"))
    rank = F.row_number().over(W.partitionBy("g").orderBy(F.desc("s"), "i"))
    out = merged.withColumn("rank", rank).filter(F.col("rank") <= n)
    return out.select(F.col("g").alias(group), "rank", F.col("i").alias(item), F.col("s").alias(score))
