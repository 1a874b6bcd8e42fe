"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, run through up to
``EPOCHS`` times. A document's virtual finish time is the cumulative words of
its source up to its end, divided by the source's target, so that all sources
reach their target at time 1 and a source with twice the target is served twice
as fast. The mix is the queue in order of finish time, cut where the total
budget, the sum of all targets, is spent: the document that a source is in the
midst of at that time is cut too, after the words that its target still lacks.

The shuffled order is by MD5 of the doc_id, so reruns agree. Cumulative words
come from two levels: a source is cut into hash ranges whose totals are summed
first, and only rows of one range meet in a task, so a source with a third of
all rows is spread over as many tasks as it has ranges.

Null or empty texts have size 0 and are taken with 0 words. A null source is a
source of its own, after all others. Rows with equal doc_id and size in one
source share their place: they are ordered among themselves by text digest, and
equal rows have equal figures up to their order. Sources are listed on the
driver, one row each, for their targets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
EPOCHS = 2
#: Rows of a source that one task orders.
RANGE_ROWS = 4_000


def source_targets(
    sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS,
    share: float = SHARE, epochs: int = EPOCHS,
) -> list[tuple[str | None, int, float]]:
    """(source, size, target) by code point, null last.

    ``weights`` repeat over the sources in that order and share ``share`` of all
    sizes. A target stops at ``epochs`` times its source's size; what it cannot
    take is shared among the others by weight, until none is above.
    """
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weighted = [(name, size, float(weights[i % len(weights)])) for i, (name, size) in enumerate(ordered)]
    budget = share * sum(size for _, size, _ in weighted)
    # those that fill first have the least room for their weight
    open_weight = sum(w for _, _, w in weighted)
    level = 0.0
    full = set()
    for i in sorted(range(len(weighted)), key=lambda k: (weighted[k][1] / weighted[k][2], k)):
        _, size, w = weighted[i]
        level = budget / open_weight if open_weight > 0 else 0.0
        if level * w < epochs * size:
            break
        full.add(i)
        budget -= epochs * size
        open_weight -= w
    return [
        (name, size, float(epochs * size) if i in full else level * w)
        for i, (name, size, w) in enumerate(weighted)
    ]


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, finish) for every document.

    ``taken`` counts words over all passes; ``finish`` is the virtual finish time
    of the document's first pass. ``keep`` names further columns to carry along.
    """
    rows = docs.select(
        "doc_id", "source", *keep, word_count().alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("place"),
        F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("digest"),
    )
    sums = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    most = max([s["rows"] for s in sums], default=0)
    digits = 1
    while most > RANGE_ROWS * 16**digits:
        digits += 1
    goals = source_targets([(s["source"], s["size"]) for s in sums], weights, share, epochs)
    if not goals:
        return rows.drop("place", "digest").withColumns({
            "source_size": F.lit(0).cast("long"), "target": F.lit(0.0), "taken": F.lit(0).cast("long"),
            "finish": F.lit(0.0),
        })
    spark = docs.sparkSession
    goal = spark.createDataFrame(goals, "source string, source_size long, target double")
    # a key without nulls: the join and the window then ask for the same shuffle
    key = ["none", "named", "range"]
    ranged = rows.withColumns({
        "none": F.col("source").isNull(), "named": F.coalesce("source", F.lit("")), "range": F.substring("place", 1, digits),
    })
    totals = ranged.groupBy("source", *key).agg(F.sum("size").alias("total"))
    offsets = totals.withColumn(
        "before",
        F.sum("total").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
        - F.col("total"),
    ).drop("total")
    bounds = offsets.join(goal, offsets.source.eqNullSafe(goal.source)).select(*key, "before", "source_size", "target")
    placed = ranged.join(bounds, key)
    inside = Window.partitionBy(*key).orderBy("place", "doc_id", "size", "digest")
    end = F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    timed = placed.withColumn("end", end)
    # words of the source's passes that lie before the target: whole ones in the middle, a part at the cut
    goal_words = F.round(F.round("target", 3)).cast("long")
    taken: Column = F.lit(0).cast("long")
    for epoch in range(epochs):
        start = F.col("end") - F.col("size") + F.lit(epoch).cast("long") * F.col("source_size")
        taken = taken + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal_words - start))
    return timed.select(
        "doc_id", "source", *keep, "size", "source_size", "target", taken.alias("taken"),
        F.when(F.col("target") > 0, F.col("end") / F.col("target")).otherwise(0.0).alias("finish"),
    )


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS,
) -> DataFrame:
    """The mix itself: one row per pass of a document, range-sorted by virtual finish time.

    The columns are those of ``docs``, whatever their names. Texts stay whole: the
    pass in which a source reaches its target is taken if at least half of its
    words fit, and left out otherwise. Documents of size 0 stay once.
    """
    rows = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    planned = mix(rows, weights, share, epochs, ["row"])
    size = F.greatest(F.col("size"), F.lit(1).cast("long"))
    passes = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor((2 * F.col("taken") + size) / (2 * size)).cast("int"))
    step = F.when(F.col("target") > 0, F.col("source_size") / F.col("target")).otherwise(0.0)
    taken = planned.where(passes > 0).withColumn("pass", F.explode(F.sequence(F.lit(0), passes - 1)))
    taken = taken.withColumn("finish", F.col("finish") + F.col("pass") * step)
    return taken.repartitionByRange("finish", "doc_id").sortWithinPartitions("finish", "doc_id").select("row.*")
