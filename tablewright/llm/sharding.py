"""Shards of near equal bytes by a histogram sort.

Documents are ordered by (XXH64 of the text, doc_id), so that equal texts are
neighbours. Splitters between shards are found without sorting: each round
counts, exactly and over all partitions, the bytes and rows below a set of
candidate keys, and then places new candidates inside the gap around each
splitter's goal, until the bytes below a candidate are within ``TOLERANCE`` of
a shard's share, or a single key is left between two candidates. Then all rows
are exchanged once.

The search runs over text hashes first, so a shard border falls between two
groups of equal texts wherever one is near enough. Only a group of several rows and
over ``WHOLE`` of a share is cut, inside, by a second search over doc_id.

A null text has no bytes and counts as the empty text; a null doc_id is ordered
before all others. doc_id must be a whole number. Rows with equal text and
doc_id cannot be told apart and share a shard. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import text_or_empty
from tablewright.session import durable

SHARDS = 24
OVERHEAD = 8
#: Part of a shard's share by which a border may miss its goal.
TOLERANCE = 0.002
#: A group of equal texts up to this part of a shard's share is never cut.
WHOLE = 0.02
#: Candidates in the gap around each goal, in each round.
PROBES = 32
#: Rows that one task numbers in the end.
RUN_ROWS = 100_000
LEAST, MOST = -(2**63), 2**63 - 1


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key, id): a slim row for each document."""
    text = text_or_empty()
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + F.lit(OVERHEAD).cast("long")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST).cast("long")).alias("id"),
    )


def gaps(slim: DataFrame, column: str, probes: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(bytes before, bytes, rows, least, greatest value) of each gap between probes that has rows.

    Counted exactly, in one pass; a task sends one small row for each gap it meets.
    """
    marks = np.asarray(probes, dtype=np.int64)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = np.zeros(len(marks) + 1, dtype=np.int64)
        rows = np.zeros(len(marks) + 1, dtype=np.int64)
        least = np.full(len(marks) + 1, MOST, dtype=np.int64)
        greatest = np.full(len(marks) + 1, LEAST, dtype=np.int64)
        for frame in frames:
            at = frame["at"].to_numpy()
            gap = np.searchsorted(marks, at, side="right")
            np.add.at(size, gap, frame["size"].to_numpy())
            np.minimum.at(least, gap, at)
            np.maximum.at(greatest, gap, at)
            rows += np.bincount(gap, minlength=len(rows))
        met = np.nonzero(rows)[0]
        yield pd.DataFrame({
            "gap": met, "size": size[met], "rows": rows[met], "least": least[met], "greatest": greatest[met],
        })

    counted = (
        slim.select(F.col(column).alias("at"), "size")
        .mapInPandas(count, "gap long, size long, rows long, least long, greatest long")
        .groupBy("gap").agg(
            F.sum("size").alias("size"), F.sum("rows").alias("rows"),
            F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        ).orderBy("gap").collect()
    )
    before, out = 0, []
    for c in counted:
        out.append((before, c["size"], c["rows"], c["least"], c["greatest"]))
        before += c["size"]
    return out


def splitters(
    slim: DataFrame, column: str, goals: list[float], allowed: list[float], whole: float,
) -> list[tuple[int, int, int] | int]:
    """For each goal in bytes a border: rows with a smaller ``column`` are before it.

    A border misses its goal by ``allowed`` at most if there is one that near.
    Otherwise it is the nearest, unless the value across the goal has several rows
    and over ``whole`` bytes: then (value, bytes before it, bytes) is given instead.
    """
    found: dict[int, tuple[int, int, int] | int] = {}
    bracket = dict.fromkeys(range(len(goals)), (LEAST, MOST, 0, 1))
    while len(found) < len(goals):
        wanted: set[int] = set()
        for i in bracket.keys() - found.keys():
            a, b, before, size = bracket[i]
            width = b - a
            # an even grid, and a finer one where an even spread would put the goal
            guess = a + int(width * max(0.0, min(1.0, (goals[i] - before) / max(1, size)))) if a > LEAST else 0
            step = max(1, width // (PROBES * PROBES))
            wanted.update(a + width * k // (PROBES + 1) for k in range(1, PROBES + 1))
            wanted.update(guess + step * k for k in range(-PROBES // 2, PROBES // 2 + 1))
            wanted.update((a, a + 1, b, b + 1))
        seen = gaps(slim, column, np.array(sorted(p for p in wanted if LEAST < p <= MOST), dtype=np.int64))
        starts = np.array([g[0] for g in seen], dtype=np.float64)
        for i in bracket.keys() - found.keys():
            before, size, rows, a, b = seen[max(0, int(np.searchsorted(starts, goals[i], side="right")) - 1)]
            miss, border = min((abs(before - goals[i]), a), (abs(before + size - goals[i]), min(b, MOST - 1) + 1))
            bracket[i] = (a, b, before, size)
            if miss <= allowed[i]:
                found[i] = border
            elif a == b:
                found[i] = border if rows == 1 or size <= whole else (a, before, size)
    return [found[i] for i in range(len(goals))]


def shards(
    docs: DataFrame, count: int = SHARDS, tolerance: float = TOLERANCE, whole: float = WHOLE,
) -> DataFrame:
    """(doc_id, size, text_crc32, key, id, shard, slot) for every document; slots have no gap in a shard."""
    slim = durable(sized(docs))
    head = slim.agg(F.sum("size").alias("size"), F.count("*").alias("rows")).first()
    total, rows = head["size"] or 0, head["rows"]
    if not rows:
        return slim.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # more borders than shards, so that the rows between two of them can be numbered by one task
    per = max(1, -(-rows // (RUN_ROWS * count)))
    runs = count * per
    goals = [total * i / runs for i in range(1, runs)]
    allowed = [total / runs * (tolerance * per if i % per == 0 else 0.1) for i in range(1, runs)]
    borders: list[tuple[int, int]] = []  # rows before (key, id) in that order are on the left
    inside: dict[tuple[int, int, int], list[int]] = {}
    for i, border in enumerate(splitters(slim, "key", goals, allowed, whole * total / count)):
        if isinstance(border, tuple):  # one large group of equal texts lies across the goal
            inside.setdefault(border, []).append(i)
        else:
            borders.append((border, LEAST))
    for (key, before, _), wants in inside.items():
        group = slim.where(F.col("key") == F.lit(key))
        for border in splitters(group, "id", [goals[i] - before for i in wants], [allowed[i] for i in wants], float("inf")):
            borders.append((key, border))
    borders.sort()
    keys = np.array([b[0] for b in borders], dtype=np.int64)
    ids = np.array([b[1] for b in borders], dtype=np.int64)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            key, id_ = frame["key"].to_numpy(), frame["id"].to_numpy()
            run = np.searchsorted(keys, key, side="left")
            # borders inside the row's own group count where they are not after its id
            for k in np.unique(key[np.isin(key, keys)]):
                at = np.nonzero(key == k)[0]
                run[at] += np.searchsorted(ids[keys == k], id_[at], side="right")
            yield frame.assign(run=run)

    kinds = dict(slim.dtypes)
    fields = ", ".join(f"{c} {'string' if c == 'doc_id' else t}" for c, t in kinds.items())
    # as text: beside a null, a large id would lose digits
    placed = slim.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(place, f"{fields}, run long")
    counts = {r["run"]: r["rows"] for r in placed.groupBy("run").agg(F.count("*").alias("rows")).collect()}
    offsets, shard_rows = [], 0
    for run in range(runs):
        shard_rows = 0 if run % per == 0 else shard_rows
        offsets.append(shard_rows)
        shard_rows += counts.get(run, 0)
    offset = F.lit(0).cast("long") if per == 1 else F.element_at(
        F.array(*[F.lit(o).cast("long") for o in offsets]), (F.col("run") + 1).cast("int")
    )
    order = Window.partitionBy("run").orderBy("key", "id")
    return placed.select(
        F.col("doc_id").cast(kinds["doc_id"]).alias("doc_id"), "size", "text_crc32", "key", "id",
        F.floor(F.col("run") / per).cast("int").alias("shard"),
        (offset + F.row_number().over(order) - 1).alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, count: int = SHARDS, tolerance: float = TOLERANCE) -> None:
    """Write whole documents as Parquet under ``path``/shard=N, in the order of their slots."""
    where = shards(docs, count, tolerance).select(
        F.col("key").alias("_key"), F.col("id").alias("_id"), "shard", "slot"
    )
    keyed = docs.withColumns({
        "_key": F.xxhash64(text_or_empty()),
        "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST).cast("long")),
    })
    where = where.groupBy("_key", "_id").agg(F.min("shard").alias("shard"), F.min("slot").alias("slot"))
    (
        keyed.join(where, ["_key", "_id"]).drop("_key", "_id")
        .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot")
        .write.partitionBy("shard").parquet(path)
    )
