"""Source files as they arrive: the batch normalisation and keys on a stream.

The keys are stateless expressions, so the stream needs neither watermark nor state; each micro-batch is a narrow stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kinfold.functions import keys as K
from kinfold.sources import schema as S


def read_sources(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New tab-separated source files of a folder, under the pinned schema."""
    r = spark.readStream.schema(S.SOURCE).option("sep", "\t").option("header", True).option("maxFilesPerTrigger", files_per_trigger)
    return r.csv(folder)


def keyed_stream(raw: DataFrame) -> DataFrame:
    """Normalised rows with the five block keys."""
    return K.with_block_keys(K.normalized(raw))


def write_keyed(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there as zstd Parquet, exactly once per file, then stops; later calls go on from the checkpoint."""
    w = stream.writeStream.format("parquet").option("compression", "zstd").option("checkpointLocation", checkpoint)
    return w.trigger(availableNow=True).start(target)
