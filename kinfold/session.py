"""Session helpers: a local session for tests, and tables written to the folder all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the library is tested under."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kinfold")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediates: ``spark.checkpoint.dir`` where the cluster names one.

    Only a local session without that setting gets a folder of its own; any other session without it is refused,
    since a machine-local folder is invisible to the other executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"file://{os.path.join(tempfile.gettempdir(), 'kinfold-' + str(os.getuid()))}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, under the application's own folder, which is deleted when the driver ends."""
    own = f"{shared_dir(spark)}/kinfold/{spark.sparkContext.applicationId}"
    if own not in _SWEPT:
        _SWEPT.add(own)
        atexit.register(_sweep, spark, own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


_SWEPT: set[str] = set()


def _sweep(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the context may be gone already; what is left is only scratch
        pass


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back.

    It cuts the lineage, gives every reader the same rows under task retries, and survives the loss of executors,
    which neither ``persist`` nor a local checkpoint does. The written files carry sizes, so AQE and the join planner
    see real statistics afterwards.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` for a join, never broadcast: for tables that grow with the data.

    Spark sizes a written table by its compressed files and the columns that are read, and one with an explode as if it
    had no more rows than before; rows sized at 10 MB took 134 MB as a hash table, and several times that in the driver.
    """
    return df.hint("merge")


_SENT: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark context, for Python functions that run there."""
    context = spark.sparkContext
    if _SENT.get("to") == context.applicationId:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="kinfold-")  # of the driver alone: Spark copies the file to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "kinfold.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    context.addPyFile(target)
    _SENT["to"] = context.applicationId


def map_batches(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``df.mapInPandas(run, schema)`` with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInPandas(run, schema)


def map_columns(df: DataFrame, run: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Batches as lists of Python values by column, in and out: Arrow without the detour over pandas.

    ``run`` gets the columns of a batch and gives those of ``schema``, of any common length.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType, _parse_datatype_string

    ship(df.sparkSession)
    fields = _parse_datatype_string(schema)
    assert isinstance(fields, StructType)
    target = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])

    def batches(it: Iterator) -> Iterator:
        for batch in it:
            out = run(batch.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(batches, schema)


def map_tables(df: DataFrame, run: Callable[[Iterator[dict[str, list]]], Iterator[dict]], schema: str) -> DataFrame:
    """Like ``map_columns`` over all batches of a task: ``run`` gets an iterator and may keep state between batches.

    A column it gives is a list, an Arrow array, or a pair of a NumPy array and a mask of its nulls (or None).
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType, _parse_datatype_string

    ship(df.sparkSession)
    fields = _parse_datatype_string(schema)
    assert isinstance(fields, StructType)
    target = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])

    def column(x, kind):
        if isinstance(x, pa.Array):
            return x.cast(kind)
        return pa.array(x[0], kind, mask=x[1]) if isinstance(x, tuple) else pa.array(x, kind)

    def batches(it: Iterator) -> Iterator:
        for out in run(b.to_pydict() for b in it):
            yield pa.RecordBatch.from_arrays([column(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(batches, schema)
