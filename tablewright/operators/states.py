"""Stored profile states: one small row per part of a table and column, and states that merge.

A part is whatever the caller groups by, such as a day or a file drop. Its state holds exact
counts, moments and extremes and three sketches: distinct values, heavy hitters and ranks.
States are written as a table; a profile of any set of parts reads only their states. Merged
states are states again, so days merge into months and months into years.

Everything is built of Spark's own mergeable aggregates: parts are combined before the shuffle
and no value of the table is shuffled. Counts, smallest and largest are exact; mean and
deviation are exact but for rounding. Distinct counts are off by more than ``distinct_bound()``
of their size, and ranks by more than ``rank_bound()`` of the rows, about once in a million
answers; counts of heavy hitters by at most ``heavy_bound()`` of the rows, and not at all while a
column has no more than ``HEAVY`` values. The modes and samples that must be exact stay with
``profile``.

NaN and infinities are missing. A column of nulls alone has no mean, extremes or quantiles, and
no distinct value. An empty table without parts gives one state a column, with parts none.
Texts over 64 characters are kept as their start and a digest.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.cells import cell_text, clean, is_numeric_field
from tablewright.operators.profile import DIGEST_MARK, LONG_TEXT, value_type_name, with_ratios

HLL_BITS = 14
HEAVY = 2000
KLL_K = 800
COLUMN = ["pos", "column", "dtype", "is_numeric_dtype"]


def distinct_bound(bits: int = HLL_BITS) -> float:
    """Five standard errors of a merged distinct count, as a share of the count."""
    return 5 * 1.04 / 2 ** (bits / 2)


def rank_bound(k: int = KLL_K) -> float:
    """Twice the error that one rank exceeds once in a hundred answers, as a share of the rows."""
    return 2 * 2.296 / k**0.9723


def heavy_bound(tracked: int = HEAVY) -> float:
    """Largest error of a heavy hitter's count, as a share of the rows."""
    return 3.5 / (tracked / 0.75)


def _token(field: T.StructField) -> Column:
    text = cell_text(field)
    short = F.concat(F.left(text, F.lit(LONG_TEXT)), F.lit(DIGEST_MARK), F.sha2(text, 256))
    return F.when(F.char_length(text) > LONG_TEXT, short).otherwise(text)


def _number(field: T.StructField) -> Column:
    if not is_numeric_field(field):
        return F.lit(None).cast("double")
    column = clean(field)
    return (column.cast("int") if isinstance(field.dataType, T.BooleanType) else column).cast("double")


def column_states(
    df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[Column] = ()
) -> DataFrame:
    """One row per part and column; ``by`` are named columns and a part may be null."""
    fields = [df.schema[c] for c in (df.columns if columns is None else columns)]
    inputs, states = [], []
    for i, f in enumerate(fields):
        inputs += [_token(f).alias(f"t{i}"), _number(f).alias(f"x{i}")]
        number = F.col(f"x{i}")
        states.append(
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(f.name).alias("column"),
                F.lit(value_type_name(f)).alias("dtype"),
                F.lit(is_numeric_field(f)).alias("is_numeric_dtype"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count(f"t{i}").alias("n_values"),
                F.count(number).alias("n_numbers"),
                F.avg(number).alias("mean"),
                (F.var_pop(number) * F.count(number)).alias("m2"),
                F.min(number).alias("low"),
                F.max(number).alias("high"),
                F.hll_sketch_agg(f"t{i}", HLL_BITS).alias("distinct"),
                F.call_function("approx_top_k_accumulate", F.col(f"t{i}"), F.lit(HEAVY)).alias("heavy"),
                F.kll_sketch_agg_double(number, KLL_K).alias("ranks"),
            )
        )
    parts = df.select(F.struct(*by).alias("by") if by else F.lit(0).alias("by"), *inputs)
    grouped = parts.groupBy("by") if by else parts.groupBy()
    wide = grouped.agg(F.array(*states).alias("states"))
    return wide.select(*(["by.*"] if by else []), F.inline("states"))


def merged_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States of larger parts: all rows of the same ``by`` and column in one.

    Squared deviations are added around the common mean, which a first pass finds, so parts
    with distant means lose no digits.
    """
    keys = [*by, *COLUMN]
    weighted = F.sum(F.col("n_numbers") * F.col("mean"))
    means = states.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.try_divide(weighted, F.sum("n_numbers")).alias("_mean")
    )
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    around = F.col("m2") + F.col("n_numbers") * (F.col("mean") - F.col("_mean")) ** 2
    return (
        states.join(means, same)
        .groupBy(*keys)
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_values").alias("n_values"),
            F.sum("n_numbers").alias("n_numbers"),
            F.first("_mean").alias("mean"),
            F.sum(around).alias("m2"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.hll_union_agg("distinct").alias("distinct"),
            F.call_function("approx_top_k_combine", F.col("heavy"), F.lit(HEAVY)).alias("heavy"),
            F.kll_merge_agg_double("ranks", KLL_K).alias("ranks"),
        )
    )


def state_stats(states: DataFrame) -> DataFrame:
    """The statistics of ``profile.column_stats``, distinct counts estimated, one row per state."""
    zero = F.lit(0.0)
    deviation = F.sqrt(F.try_divide("m2", F.col("n_numbers").cast("double")))
    return with_ratios(
        states.withColumns(
            {
                "total_vals": F.col("n_rows"),
                "num_nans": F.col("n_rows") - F.col("n_values"),
                "num_of_dist_val": F.hll_sketch_estimate("distinct"),
                "mean": F.coalesce("mean", zero),
                "std_dev": F.coalesce(deviation, zero),
                "min_val": F.coalesce("low", zero),
                "max_val": F.coalesce("high", zero),
            }
        ).drop("n_rows", "n_values", "n_numbers", "m2", "low", "high", "distinct", "heavy", "ranks")
    )


def _heavy(n: int) -> Column:
    # Spark counts null as a value of its own
    found = F.call_function("approx_top_k_estimate", F.col("heavy"), F.lit(n + 1))
    return F.slice(F.filter(found, lambda one: one["item"].isNotNull()), 1, n)


def state_heavy_hitters(states: DataFrame, n: int = 20) -> DataFrame:
    """(parts, pos, column, value, n): the ``n`` most frequent values of each state."""
    keys = [c for c in states.columns[: states.columns.index("n_rows")] if c not in ("dtype", "is_numeric_dtype")]
    return states.select(*keys, F.inline(_heavy(n)).alias("value", "n"))


def state_category_size(states: DataFrame) -> DataFrame:
    """Binary, small, large or none, as ``profile.category_size`` has it."""
    distinct, values = F.hll_sketch_estimate("distinct"), F.col("n_values")
    top = F.aggregate(_heavy(20), F.lit(0).cast("bigint"), lambda total, one: total + one["count"])
    size = (
        F.when(distinct <= 2, "binary")
        .when((distinct <= 20) & (F.try_divide(distinct, values) < 0.3), "small")
        .when(F.try_divide(top, values) > 0.8, "large")
        .otherwise("none")
    )
    return states.withColumn("category_size", size).drop(*states.columns[states.columns.index("n_rows"):])


def quantile(ranks: Column, share: float) -> Column:
    """The value at a share of the rows of a rank sketch; null if it has seen none."""
    return F.when(F.kll_sketch_get_n_double(ranks) > 0, F.kll_sketch_get_quantile_double(ranks, F.lit(float(share))))


def sketched_quantiles(
    df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], names: Sequence[str], k: int = KLL_K
) -> DataFrame:
    """Quantiles per group from rank sketches: no sort, and a group is combined before the shuffle.

    Shares 0 and 1 are the exact smallest and largest. The rank of any other answer is within
    ``rank_bound(k)`` of its share. ``n`` is the number of values; a group without any has nulls.
    """
    number = clean(df.schema[value]).cast("double")
    sketches = df.groupBy(*by).agg(F.kll_sketch_agg_double(number, k).alias("_ranks"))
    answers = [quantile(F.col("_ranks"), p).alias(n) for p, n in zip(shares, names)]
    return sketches.select(*by, F.kll_sketch_get_n_double("_ranks").alias("n"), *answers)
