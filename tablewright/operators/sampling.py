"""Reproducible splits, capped samples and histogram bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.cells import clean
from tablewright.operators.ranking import top_per_group

# Split in percent, class count above which caps shrink.
SPLIT = {"train": 60, "validation": 15, "test": 25}
MANY_CLASSES = 25


def key_text(key: str | Sequence[str]) -> Column:
    names = [key] if isinstance(key, str) else list(key)
    return F.concat_ws("|", *[F.col(k).cast("string") for k in names])


def hash_bucket(key: str | Sequence[str]) -> Column:
    """0..99 from the row key, the same on every run and partitioning."""
    return F.conv(F.substring(F.md5(key_text(key)), 1, 4), 16, 10).cast("int") % 100


def hash_split(df: DataFrame, key: str | Sequence[str], weights: dict[str, int] = SPLIT) -> DataFrame:
    """Add ``split`` by hash of the key."""
    label, edge = None, 0
    for name, weight in weights.items():
        edge += weight
        test = hash_bucket(key) < edge
        label = F.when(test, name) if label is None else label.when(test, name)
    return df.withColumn("split", label.otherwise(name))


def class_cap(df: DataFrame, target: str, n: int) -> int:
    """Rows allowed per class, fewer when there are many classes, one at least."""
    few = df.select(target).filter(F.col(target).isNotNull()).distinct()
    classes = few.count()
    return max(1, int(n * MANY_CLASSES / classes)) if classes > MANY_CLASSES else n


def cap_per_class(df: DataFrame, by: str, n: int, key: str | Sequence[str]) -> DataFrame:
    """At most ``n`` rows per class, chosen by hash of the key."""
    names = [key] if isinstance(key, str) else list(key)
    order = [F.md5(key_text(key)), *[F.col(k) for k in names]]
    return top_per_group(df, [by], order, n, spread=names, rank="_rank").drop("_rank")


def doane_bins(df: DataFrame, column: str) -> DataFrame:
    """(low, high, bins) of a column by Doane's rule; NaN and infinities are missing."""
    value = clean(df.schema[column]).cast("double")
    stats = df.agg(
        F.count(value).cast("double").alias("n"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.abs(F.skewness(value)).alias("skew"),
    )
    n = F.col("n")
    error = F.sqrt(6.0 * (n - 2) / ((n + 1) * (n + 3)))
    bins = F.ceil(1.0 + F.log2(n) + F.log2(1.0 + F.col("skew") / error))
    usable = (n > 2) & (F.col("high") > F.col("low"))
    return stats.select("low", "high", F.when(usable, bins).otherwise(F.lit(1)).cast("int").alias("bins"))


def bin_of(value: Column, low: Column, high: Column, bins: Column) -> Column:
    """Half-open bins from 1; the largest value belongs to the last."""
    return (
        F.when(value.isNull(), F.lit(None))
        .when(low == high, F.lit(1))
        .when(value == high, bins)
        .otherwise(F.width_bucket(value, low, high, bins))
        .cast("int")
    )


def capped_sample(
    df: DataFrame, target: str, n: int, key: str | Sequence[str], task: str = "classification"
) -> DataFrame:
    """Stratified sample by class, or by target bin for regression."""
    if task == "classification":
        return cap_per_class(df, target, class_cap(df, target, n), key)
    edges = doane_bins(df, target).first()
    if edges["low"] is None:
        return df
    bins = edges["bins"]
    cap = max(1, int(n * MANY_CLASSES / bins)) if bins > MANY_CLASSES else n
    value = clean(df.schema[target]).cast("double")
    binned = df.withColumn(
        "_bin", bin_of(value, F.lit(edges["low"]), F.lit(edges["high"]), F.lit(bins))
    )
    return cap_per_class(binned, "_bin", cap, key).drop("_bin")
