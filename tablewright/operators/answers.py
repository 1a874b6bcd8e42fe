"""Frames behind common answers and charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.cells import SENTINELS, clean, null_sentinel
from tablewright.operators.ranking import exact_quantiles, ordered_prefix, top_per_group
from tablewright.operators.sampling import bin_of, doane_bins

QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
QUARTILE_NAMES = ("low", "q1", "median", "q3", "high")


def scalar(df: DataFrame, value: Column, name: str = "answer") -> DataFrame:
    """One unrounded value."""
    return df.agg(value.alias(name))


def ordered_list(df: DataFrame, value: str, tie: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """(position, value..): values in order, numbered over all ranges of the sort."""
    rows = df.select(value, *tie)
    return ordered_prefix(rows, [value, *tie], out="position", descending=descending)


def ranking(df: DataFrame, by: str, value: Column, k: int, descending: bool = True) -> DataFrame:
    """(position, by, value): the ``k`` groups with the largest values, ties by group."""
    grouped = df.groupBy(by).agg(value.alias("value"))
    order = F.col("value").desc() if descending else F.col("value").asc()
    head = grouped.orderBy(order, by).limit(k).withColumn("_g", F.lit(0))
    return top_per_group(head, ["_g"], [order, F.col(by)], k, rank="position").drop("_g")


def series(df: DataFrame, x: Column, y: Column, legend: Column | None = None) -> DataFrame:
    """(x, legend, y) for line, scatter and bar charts."""
    keys = [x.alias("x"), (F.lit("") if legend is None else legend).alias("legend")]
    return df.groupBy(*keys).agg(y.alias("y"))


def share(df: DataFrame, x: Column, y: Column, legend: Column) -> DataFrame:
    """(x, legend, y, share): each part's share of the total of its x."""
    cells = series(df, x, y, legend)
    totals = cells.groupBy("x").agg(F.sum("y").alias("_total"))
    return cells.join(totals, "x").withColumn("share", F.try_divide("y", "_total")).drop("_total")


def heatmap_cells(df: DataFrame, x: str, y: str, value: Column) -> DataFrame:
    """(x, y, value): the heatmap in long form, for any number of columns; null is a value."""
    return df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(value.alias("value"))


def heatmap(df: DataFrame, x: str, y: str, value: Column, columns: Sequence) -> DataFrame:
    """One row per x and one column for each value of y that the caller lists.

    A listed None is the column ``null``. Values that are not listed have no
    column; an x that has only such values keeps its row.
    """
    place = F.lit(None).cast("int")
    for i, c in enumerate(columns):
        place = F.when(F.col(y).eqNullSafe(F.lit(c)), F.lit(i)).otherwise(place)
    wide = df.withColumn("_at", place).groupBy(x).pivot("_at", list(range(len(columns)))).agg(value)
    return wide.select(x, *[F.col(f"`{i}`").alias("null" if c is None else str(c)) for i, c in enumerate(columns)])


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x, y, correlation) of every pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = []
    for a, b in pairs:
        value = F.col(f"`{a}|{b}`").alias("correlation")
        cells.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), value))
        if a != b:
            cells.append(F.struct(F.lit(b).alias("x"), F.lit(a).alias("y"), value))
    return row.select(F.inline(F.array(*cells)))


def five_numbers(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Smallest, quartiles and largest value per group, over all rows."""
    return exact_quantiles(df, by, value, QUARTILES, QUARTILE_NAMES)


def histogram(df: DataFrame, column: str, bins: int | str = "doane") -> DataFrame:
    """(bin, low, high, n): rows per equal-width bin, empty bins left out; NaN and infinities are missing."""
    edges = doane_bins(df, column)
    if isinstance(bins, int):
        edges = edges.withColumn("bins", F.lit(bins))
    value = clean(df.schema[column]).cast("double")
    edge = edges.select(F.struct("low", "high", "bins")).first()[0]  # one row
    if edge["low"] is None:
        edge = {"low": 0.0, "high": 0.0, "bins": 1}
    low, high, count = F.lit(edge["low"]), F.lit(edge["high"]), F.lit(edge["bins"])
    width = (high - low) / count
    return (
        df.select(bin_of(value, low, high, count).alias("bin"))
        .filter(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "bin", (low + (F.col("bin") - 1) * width).alias("low"), (low + F.col("bin") * width).alias("high"), "n"
        )
    )


def panels(frames: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Several (x, legend, y) frames under one another with a ``panel`` name."""
    out = None
    for name, frame in frames:
        one = frame.select(
            F.lit(name).alias("panel"),
            F.col("x").cast("string").alias("x"),
            F.col("legend").cast("string").alias("legend"),
            F.col("y").cast("double").alias("y"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def null_sentinels(df: DataFrame, columns: Sequence[str], values: Sequence[str] = SENTINELS) -> DataFrame:
    """Stand-ins for missing cells turned into null."""
    return df.withColumns({c: null_sentinel(F.col(c), values) for c in columns})


def exclude_totals(df: DataFrame, column: str, labels: Sequence[str] = ("total", "all", "overall")) -> DataFrame:
    """Drop the rows of a category that stand for all others."""
    return df.filter(~F.coalesce(F.lower(F.trim(F.col(column))).isin(*labels), F.lit(False)))
