"""Order-dependent building blocks that never put a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.cells import clean
from tablewright.session import durable

SALTS = 64
#: Bytes of a lookup, as JSON, that may be broadcast.
SMALL_BYTES = 8_000_000
#: Rows that one range of an ordered prefix should hold.
RANGE_ROWS = 2_000_000


def slices(df: DataFrame) -> int:
    """Slices to cut a hot group into; grows with the shuffle partitions."""
    return max(SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def top_per_group(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread: Sequence[str] = (),
    salts: int | None = None,
    rank: str = "rank",
) -> DataFrame:
    """First ``k`` rows of every group, ranked from 1.

    With ``spread`` columns a hot group is first cut to ``k`` rows inside each of
    ``salts`` slices (at least one per shuffle partition), so the last ranking sees
    at most ``salts * k`` rows per group.
    """
    rows = df
    if spread:
        salts = salts or slices(df)
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
        slice_window = Window.partitionBy(*by, "_salt").orderBy(*order)
        rows = (
            salted.withColumn("_slice_rank", F.row_number().over(slice_window))
            .filter(F.col("_slice_rank") <= k)
            .drop("_slice_rank", "_salt")
        )
    window = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def ordered_prefix(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    weight: str | None = None,
    out: str = "upto",
    descending: bool = False,
) -> DataFrame:
    """Running total of ``weight`` (rows when none) in ``order`` inside ``by``.

    Rows are range-partitioned and every range adds up on its own; only one
    total per range and group is then summed up, which is a small frame. The
    order columns should be unique inside a group.
    """
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, -(-df.count() // RANGE_ROWS))
    direction = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    weighted = df.withColumn("_w", F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint"))
    ranged = durable(
        weighted.repartitionByRange(ranges, *[F.col(c) for c in by], *direction)
        .withColumn("_range", F.spark_partition_id())
    )
    keys = ["_range", *by]
    totals = ranged.groupBy(*keys).agg(F.sum("_w").alias("_total"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")
    )
    if not by:
        offsets = F.broadcast(offsets)  # one row per range
    inside = (
        Window.partitionBy(*keys).orderBy(*direction).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        ranged.withColumn("_inside", F.sum("_w").over(inside))
        .join(offsets, keys)
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_range", "_w", "_inside", "_offset")
    )


def small_or_shuffled(lookup: DataFrame, max_bytes: int = SMALL_BYTES) -> DataFrame:
    """Broadcast a lookup only when its summed bytes show it is small.

    The lookup is written once, then measured and joined. A larger one is joined by
    shuffle, where adaptive execution splits hot keys.
    """
    lookup = durable(lookup)
    return F.broadcast(lookup) if is_small(lookup, max_bytes) else lookup


def is_small(lookup: DataFrame, max_bytes: int = SMALL_BYTES) -> bool:
    """Whether all rows, as JSON, fit the bytes."""
    return (lookup.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= max_bytes


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Interpolated quantiles per group over all rows, counted by distinct value.

    NaN and infinities are missing; a group without values has no row.
    """
    by = list(by)
    counts = (
        df.select(*by, clean(df.schema[value]).cast("double").alias("_v"))
        .filter(F.col("_v").isNotNull())
        .groupBy(*by, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = ordered_prefix(counts, ["_v"], by, weight="_n", out="_upto")
    # The last running total of a group is its size; the ranked counts are already written.
    sizes = ranked.groupBy(*by).agg(F.max("_upto").alias("_size"))
    if by:
        placed = ranked.join(small_or_shuffled(sizes), by)
    else:
        placed = ranked.withColumn("_size", sizes.scalar())
    picks = []
    for i, p in enumerate(probs):
        at = (F.col("_size") - 1) * F.lit(float(p))
        for side, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            holds = (F.col("_upto") > index) & (F.col("_upto") - F.col("_n") <= index)
            picks.append(F.max(F.when(holds, F.col("_v"))).alias(f"_{side}{i}"))
    picked = placed.groupBy(*by).agg(F.max("_size").alias("_size"), *picks)
    out = []
    for i, (p, name) in enumerate(zip(probs, names)):
        at = (F.col("_size") - 1) * F.lit(float(p))
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((low + (at - F.floor(at)) * (high - low)).alias(name))
    return picked.select(*by, *out)
