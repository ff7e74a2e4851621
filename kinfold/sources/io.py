"""Readers and writers: tab-separated sources, Parquet, single-file sinks and registered views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinfold.sources import schema as S


def read_tsv(spark: SparkSession, path: str, schema: StructType = S.SOURCE, quote: str | None = '"', multi_line: bool = False) -> DataFrame:
    """Tab-separated file with a header under a pinned schema.

    ``quote=None`` switches quoting off, so quotation marks stay in the values. An empty field is null, quoted or not;
    leading and trailing spaces are kept. ``multi_line`` reads quoted line breaks as part of a value; such a file cannot
    be divided, so it is one task, whatever its size: leave it off where no value holds a line break.
    """
    r = spark.read.schema(schema).option("sep", "\t").option("header", True).option("enforceSchema", True)
    r = r.option("multiLine", multi_line and quote is not None)
    r = r.option("quote", quote).option("escape", quote) if quote else r.option("quote", "")
    return r.csv(path)


def read_key_lines(spark: SparkSession, path: str, schema: StructType = S.TRUTH) -> DataFrame:
    """Line scan that splits at the first tab only; lines without a tab and the header line are skipped."""
    left, right = schema.names
    parts = F.split("value", "\t", 2)
    lines = spark.read.text(path).filter(F.col("value").contains("\t"))
    return lines.select(parts[0].alias(left), parts[1].alias(right)).filter(F.col(left) != left)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """zstd Parquet, one file per task."""
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_tsv(df: DataFrame, path: str, order_by: list[str] | None = None, quote: str | None = '"') -> None:
    """A folder of tab-separated files with headers, ordered across them by ``order_by``. ``quote=None`` never quotes."""
    w = (df.orderBy(*order_by) if order_by else df).write.option("sep", "\t").option("header", True)
    w = w.option("escape", quote).option("emptyValue", quote * 2) if quote else w.option("quote", "\u0000").option("emptyValue", "")
    w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def deliver_tsv(df: DataFrame, path: str, order_by: list[str], quote: str | None = '"') -> None:
    """One tab-separated file at ``path`` with a header, ordered.

    One task sorts, with spilling, and writes all rows, as one ordered file asks for. The file is moved to ``path`` when
    it is whole, replacing a file that was there.
    """
    spark = df.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder, target = fs_path(f"{path}.parts"), fs_path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(folder, True)
    write_tsv(df.repartition(1).sortWithinPartitions(*order_by), f"{path}.parts", quote=quote)
    part = next(f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    fs.delete(target, False)
    fs.rename(part, target)
    fs.delete(folder, True)


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> list[str]:
    """Registers lazily evaluated views; gives their names in order."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return sorted(tables)


def describe(df: DataFrame) -> DataFrame:
    """Column names and types of ``df`` as rows."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, column_type string")
