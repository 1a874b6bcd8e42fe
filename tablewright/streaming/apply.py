"""Apply fitted transforms to a streaming frame."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def stream_table(spark: SparkSession, path: str, schema: T.StructType | str, format: str = "csv", **options) -> DataFrame:
    """Files that arrive under ``path`` as a stream; the schema is given, not inferred."""
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def transform_stream(model: Model, stream: DataFrame) -> DataFrame:
    """Fitted transforms are projections or lookups, so a stream passes through row by row."""
    if not stream.isStreaming:
        raise ValueError("transform a static frame with model.transform()")
    return model.transform(stream)
