"""Principal components of wide sparse rows, with every long side as a DataFrame.

Entries are (row, at, value). The block of directions is a DataFrame of one array
a place, and block power iteration multiplies it by joins: entries meet the block
by place and are summed by row, and meet the rows' products again and are summed by
place. Sums are combined before each shuffle. Means are taken off as a rank-one
term, so entries stay sparse. The driver sees only square matrices as wide as the
block, from which it gets the factor that makes the block orthonormal; no vocabulary
and no block passes through it. Each round is written to the shared folder.

Null values count as zero, and places or rows without entries as all zeros. Entries
of one row and place are added up. Directions that the rows do not span are left
out, so there may be fewer than ``k`` components; without entries there are none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import durable

#: Further directions beside the components, and rounds.
SPARE, ROUNDS = 10, 8
#: A direction with less than this part of the largest one's square is not spanned.
RANK = 1e-20


@dataclass
class Components:
    """Directions (at, part) with one number a component, their variances and the total variance."""

    parts: DataFrame
    variance: list[float]
    total: float


def _sums(width: int) -> list:
    return [F.sum(F.col("value") * F.col("block")[j]).alias(f"s{j}") for j in range(width)]


def _array(width: int):
    return F.array(*[F.col(f"s{j}") for j in range(width)])


def _times(df: DataFrame, key: str, matrix: np.ndarray, out: str = "block") -> DataFrame:
    """(key, out): the arrays in ``block`` times a small matrix."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({key: frame[key], out: list(np.stack(frame["block"].to_numpy()) @ matrix)})

    kind = dict(df.dtypes)[key]
    return df.select(key, "block").mapInPandas(run, f"`{key}` {kind}, `{out}` array<double>")


def _gram(df: DataFrame, width: int) -> np.ndarray:
    """Sum of the outer squares of the arrays in ``block``: partial sums a task, then by cell."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for frame in frames:
            if len(frame):
                some = np.stack(frame["block"].to_numpy())
                total += some.T @ some
        yield pd.DataFrame({"i": np.arange(width), "line": list(total)})

    cells = df.select("block").mapInPandas(run, "i int, line array<double>").select("i", F.posexplode("line").alias("j", "v"))
    out = np.zeros((width, width))
    # width squared numbers
    for i, j, v in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[i, j] = v
    return out


def _orthonormal(block: DataFrame, width: int, times: int = 1) -> tuple[DataFrame, int]:
    """The block with orthonormal columns that span the same, and how many these are; a second time takes off what rounding left."""
    for _ in range(times):
        values, vectors = np.linalg.eigh(_gram(block, width))
        keep = values > RANK * max(values.max(initial=0.0), 0.0)
        if not keep.any():
            return block, 0
        block = durable(_times(block, "at", vectors[:, keep] / np.sqrt(values[keep])))
        width = int(keep.sum())
    return block, width


def principal_components(entries: DataFrame, count: int, k: int, rounds: int = ROUNDS) -> Components:
    """The ``k`` first components of ``count`` rows given by their entries (row, at, value)."""
    entries = durable(
        entries.select("row", "at", F.col("value").cast("double").alias("value")).groupBy("row", "at").agg(F.sum("value").alias("value"))
        .where("value <> 0")
    )
    sums = durable(entries.groupBy("at").agg(F.sum("value").alias("sum"), F.sum(F.col("value") * F.col("value")).alias("square")))
    mean = sums.select("at", (F.col("sum") / count).alias("mean"))
    places, squares = sums.agg(F.count("*"), F.sum(F.col("square") - F.col("sum") * F.col("sum") / count)).first()
    if not places or count < 2:
        return Components(sums.select("at", F.array().cast("array<double>").alias("part")), [], 0.0)
    width = min(places, count, k + SPARE)
    # a start that depends on the place alone, so reruns agree
    start = F.array(*[F.xxhash64("at", F.lit(j)).cast("double") / F.lit(2.0**63) for j in range(width)])
    block, width = _orthonormal(mean.select("at", start.alias("block")), width, 2)

    def products(block: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
        """Centred rows times the block, for rows with entries, and what a row without entries gives."""
        shift = mean.withColumnRenamed("mean", "value").join(block, "at").agg(*_sums(width)).first()
        off = np.array([x or 0.0 for x in shift])
        made = entries.join(block, "at").groupBy("row").agg(*_sums(width)).select("row", _array(width).alias("block"))
        return durable(made.select("row", F.zip_with("block", F.array(*map(F.lit, off.tolist())), lambda a, b: a - b).alias("block"))), -off

    # a block as wide as the space needs no rounds
    for left in range(rounds if width < places else 0, 0, -1):
        made, _ = products(block, width)
        back = entries.join(made, "row").groupBy("at").agg(*_sums(width)).select("at", _array(width).alias("block"))
        # products of centred rows add up to zero, so the means' term is nothing on the way back
        block, width = _orthonormal(durable(back), width, 2 if left == 1 else 1)
        if not width:
            return Components(sums.select("at", F.array().cast("array<double>").alias("part")), [], 0.0)
    made, bare = products(block, width)
    inner = _gram(made, width) + np.outer(bare, bare) * (count - made.count())
    values, vectors = np.linalg.eigh(inner / (count - 1))
    order = np.argsort(-values)[:k]
    parts = durable(_times(block, "at", vectors[:, order], "part"))
    # the number of largest size in each component is positive
    top = parts.agg(*[F.max_by(F.col("part")[j], F.struct(F.abs(F.col("part")[j]), "at")).alias(f"t{j}") for j in range(len(order))]).first()
    signs = F.array(*[F.lit(-1.0 if t < 0 else 1.0) for t in top])
    signed = parts.select("at", F.zip_with("part", signs, lambda a, b: a * b).alias("part"))
    return Components(signed, values[order].tolist(), squares / (count - 1))


def project(entries: DataFrame, parts: DataFrame, k: int, keys: Sequence[str] = ("row",)) -> DataFrame:
    """(keys, scores): the rows' products with the directions, not centred; rows without entries are left out."""
    joined = entries.join(parts.withColumnRenamed("part", "block"), "at")
    return joined.groupBy(*keys).agg(*_sums(k)).select(*keys, _array(k).alias("scores"))
