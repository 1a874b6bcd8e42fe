"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(column: str = "text") -> Column:
    """The text, with null read as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    """Number of runs without ASCII white space; null counts none."""
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def in_slices(frames: Iterator[pd.DataFrame], rows: int = 512) -> Iterator[pd.DataFrame]:
    """The same rows in smaller frames, so that what a task makes of them is sent on in small pieces."""
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at : at + rows].reset_index(drop=True)


def map_exactly(df: DataFrame, run, schema: str | T.StructType) -> DataFrame:
    """``mapInPandas`` in which whole numbers of ``df`` travel as text.

    A batch with a null would turn them into floating-point numbers, and large ones
    into others. Columns of ``schema`` named as such are cast back afterwards.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = {f.name: f.dataType for f in df.schema if isinstance(f.dataType, T.IntegralType)}
    sent = df.withColumns({c: F.col(f"`{c}`").cast("string") for c in whole})
    made = sent.mapInPandas(run, T.StructType([
        T.StructField(f.name, T.StringType() if f.name in whole else f.dataType) for f in fields
    ]))
    return made.select(*[
        F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in whole else F.col(f"`{f.name}`") for f in fields
    ])


def partitions_for(rows: int, rows_each: int, least: int = 1) -> int:
    """Tasks so that each gets about ``rows_each`` rows: grows with the input, without an upper end."""
    return max(least, -(-rows // rows_each))


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
