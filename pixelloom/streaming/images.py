"""Images as a stream: new files of a folder are detected and decoded as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators.decode import decode
from pixelloom.sources.images import FILE_SCHEMA


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of (path, modificationTime, length, content)."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", str(files_per_trigger)).load(folder)


def decode_stream(files: DataFrame) -> DataFrame:
    """A stream of surfaces; stateless, so exactly as the batch decode."""
    return decode(files)


def counts(surfaces: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Surfaces and errors by codec and window of modification time; the watermark bounds the state."""
    timed = surfaces.withWatermark("modificationTime", late)
    return timed.groupBy(F.window("modificationTime", window), "codec", "error").count()
