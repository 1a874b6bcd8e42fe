"""Groups of texts that share at least a given part of their word shingles.

Candidates come from MinHash: ``BANDS`` keys of ``ROWS`` minima each are made of
a text's set of shingles, and texts with a key in common form a bucket. Two
texts of similarity 0.8 have no key in common with a chance of
``(1 - 0.8**5)**32``, three in a million, and less the more alike they are.
Links are confirmed by the exact Jaccard similarity of the two sets, and groups
are what confirmed links reach.

*Centres.* No bucket makes its pairs. In each, the text that meets most others
over all its buckets is the centre, the original of a family of copies rather
than one of its copies, and only it is compared with the others: one pair a row.

*Rare shingles.* What a centre leaves apart meets again by a prefix filter, which
loses no pair. Shingles are ordered by the number of open texts that hold them,
rarest first. Sets of sizes n and m with similarity s share
``s / (1 + s) * (n + m)`` shingles, so both hold a common one among their first
``n + 1`` less that many. A copy with so many edits that it is no near copy has
only shingles of its own there, and meets nobody. Only shingles held by several
groups count, and only where enough shingles are left for the smallest text that
holds them. Of texts that meet, the first ``FIRST`` are compared with the others of
other groups, then more of them at once, until each place of meeting holds one
group or has been compared in full.

White space and ASCII case do not count. A text shorter than a shingle is one
shingle. Null, empty and blank texts have no shingle and are alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import in_slices, map_exactly, text_or_empty
from tablewright.llm.components import components
from tablewright.session import written

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
SEED = 42
#: Shingles whose minima are taken at once.
BLOCK = 1_024
#: First texts of a place of meeting that are compared with its others, and their growth from round to round.
FIRST, MORE = 64, 4
#: Parts in which the comparisons of one text are dealt out.
PARTS = 256
#: Texts whose shingles a task holds at once.
SLICE = 64
#: Below this a difference of two shares is rounding.
TINY = 1e-9

_DRAWN = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)
_TURN, _TIMES = _DRAWN[0][:, None], _DRAWN[1][:, None] | np.uint64(1)


def text_key():
    """The node of a text, 128 bits: equal texts share it."""
    return F.md5(text_or_empty().cast("binary"))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    width = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - width + 1], ends[width - 1 :]
    hashes = (xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    return np.unique(np.fromiter(hashes, dtype=np.uint64, count=len(starts)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a set of shingles, as signed numbers; the empty set has keys of its own."""
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(least, ((hashes[at : at + BLOCK] ^ _TURN) * _TIMES).min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def similarity(left: np.ndarray, right: np.ndarray) -> float:
    """Exact Jaccard similarity of two sets; 1 for two empty ones."""
    both = len(np.intersect1d(left, right, assume_unique=True))
    either = len(left) + len(right) - both
    return both / either if either else 1.0


def buckets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(bucket, node, size, n): the distinct texts of each bucket of two or more, their shingles, and the bucket's texts."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_slices(frames):
            sets = [shingles(t, words) for t in frame["text"]]
            yield pd.DataFrame({"node": frame["node"], "size": [str(len(s)) for s in sets], "keys": [band_keys(s) for s in sets]})

    made = map_exactly(
        docs.select(text_key().alias("node"), F.lit(0).cast("long").alias("size"), text_or_empty().alias("text")),
        run, "node string, size long, keys array<long>",
    )
    keyed = written(made.select("node", "size", F.explode("keys").alias("bucket")).distinct())
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return written(keyed.join(shared, "bucket").select("bucket", "node", "size", "n"))


def similar_groups(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY, known: DataFrame | None = None) -> DataFrame:
    """(node, component) of the distinct texts (``text_key``) that have a similar one.

    ``known`` gives candidates (a, b) of another index: they are confirmed first, and
    only texts that they leave apart are compared.
    """
    met = buckets(docs, words)
    texts = written(
        docs.select(text_key().alias("node"), text_or_empty().alias("text")).groupBy("node").agg(F.first("text").alias("text"))
        .join(met.select("node").distinct(), "node")
    )
    pairs = centre_pairs(met, least)
    if known is None:
        links = written(confirmed(pairs, texts, words, least))
    else:
        near = written(confirmed(known, texts, words, least))
        links = written(confirmed(_apart(pairs, components(near)), texts, words, least).unionByName(near))
    groups = components(links)
    waiting = prefixes(open_texts(met, groups), texts, words, least)
    first = FIRST
    while not waiting.isEmpty():
        place = F.row_number().over(Window.partitionBy("bucket").orderBy("node"))
        leaders = written(waiting.withColumn("place", place).where(F.col("place") <= first).drop("place"))
        pairs = waiting.alias("m").join(leaders.alias("l"), "bucket").where(
            (F.col("l.component") != F.col("m.component"))
            & (F.least("l.size", "m.size") >= F.greatest("l.size", "m.size") * F.lit(least))
            & (F.least("l.rest", "m.rest") >= (F.col("l.size") + F.col("m.size")) * F.lit(least / (1 + least)) - F.lit(TINY))
        ).select(F.least("l.node", "m.node").alias("a"), F.greatest("l.node", "m.node").alias("b")).distinct()
        new = written(confirmed(pairs, texts, words, least))
        if not new.isEmpty():
            links = links.unionByName(new)
            groups = components(links)
        left = waiting.drop("component").join(leaders.select("bucket", "node"), ["bucket", "node"], "left_anti")
        waiting = written(_of_several(left.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))))
        first *= MORE
    return groups


def _of_several(entries: DataFrame, group: str = "component") -> DataFrame:
    """The rows of buckets that hold several groups."""
    several = entries.groupBy("bucket").agg(F.min(group).alias("low"), F.max(group).alias("high")).where("low < high")
    return entries.join(several.select("bucket"), "bucket", "left_semi")


def centre_pairs(met: DataFrame, least: float) -> DataFrame:
    """(a, b): the centre of a bucket with each other text of it whose size allows a link."""
    weight = met.groupBy("node").agg(F.sum("n").alias("weight"))
    centre = met.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node", "size")).alias("centre"))
    return met.join(centre, "bucket").where(
        (F.col("node") != F.col("centre.node"))
        & (F.least("size", "centre.size") >= F.greatest("size", "centre.size") * F.lit(least))
    ).select(F.col("centre.node").alias("a"), F.col("node").alias("b")).distinct()


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are in different groups."""
    for side in ("a", "b"):
        of = groups.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
        pairs = pairs.join(of, side, "left").withColumn(f"of_{side}", F.coalesce(f"of_{side}", side))
    return pairs.where("of_a <> of_b").select("a", "b")


def open_texts(met: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, component) of the texts that share a bucket with a text of another group."""
    named = met.select("bucket", "node").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return written(_of_several(named).select("node", "component").distinct())


def prefix_length(size: int, least: float) -> int:
    """So many of the first of ``size`` shingles hold one of any similar set, the least of which has ``least * size``."""
    smallest = math.ceil(size * least - TINY)
    return size - math.ceil(least / (1 + least) * (size + smallest) - TINY) + 1


def prefixes(waiting: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """(bucket, node, size, rest, component): the rare shingles of open texts by which they may meet another group.

    A bucket is a shingle; ``rest`` counts the shingles of a text from that one on,
    which are all that it can share with a text that it meets there first.
    """
    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_slices(frames, SLICE):
            sets = [shingles(t, words).view(np.int64) for t in frame["text"]]
            of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            yield pd.DataFrame({
                "id": frame["id"].to_numpy()[of], "group": frame["group"].to_numpy()[of], "shingle": np.concatenate(sets),
            })

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_slices(frames, SLICE):
            sizes = np.array([len(x) for x in frame["shingle"]], dtype=np.int64)
            at = [np.nonzero(np.asarray(x, dtype=bool)[: prefix_length(len(x), least)])[0] for x in frame["several"]]
            of = np.repeat(np.arange(len(at)), [len(x) for x in at])
            yield pd.DataFrame({
                "bucket": np.concatenate([np.asarray(x, dtype=np.int64)[i] for x, i in zip(frame["shingle"], at, strict=True)]),
                "id": frame["id"].to_numpy()[of], "size": sizes[of], "rest": sizes[of] - np.concatenate(at),
                "group": frame["group"].to_numpy()[of],
            })

    # short numbers for the names while there is a row a shingle; they stay, as they are written
    numbered = written(waiting.withColumn("id", F.monotonically_increasing_id()))
    named = written(numbered.join(numbered.groupBy("component").agg(F.min("id").alias("group")), "component"))
    held = written(
        named.join(texts, "node").select("id", "group", "text").mapInPandas(split, "id long, group long, shingle long")
    )
    rarity = held.groupBy("shingle").agg(F.count("*").alias("texts"), (F.min("group") < F.max("group")).alias("several"))
    # one text's shingles are one row, as its text is
    ordered = held.join(rarity, "shingle").groupBy("id", "group").agg(
        F.array_sort(F.collect_list(F.struct("texts", "shingle", "several"))).alias("of")
    ).select("id", "group", F.col("of.shingle").alias("shingle"), F.col("of.several").alias("several"))
    entries = written(ordered.mapInPandas(cut, "bucket long, id long, size long, rest long, group long"))
    # what is left of a text must suffice for the smallest text that it meets
    smallest = entries.groupBy("bucket").agg(F.min("size").alias("least"))
    able = entries.join(smallest, "bucket").where(
        F.col("rest") >= (F.col("size") + F.greatest("least", F.col("size") * F.lit(least))) * F.lit(least / (1 + least)) - F.lit(TINY)
    )
    several = _of_several(written(able.drop("least")), "group")
    return written(several.drop("group").join(named.select("id", "node", "component"), "id").drop("id"))


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar; the comparisons of one text go to many tasks.

    Each task reads a text ``a`` once and then, one by one, those that it is compared with.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            keep = []
            for b, text in zip(frame["b"], frame["text"], strict=True):
                if not b:
                    held = shingles(text, words)
                keep.append(bool(b) and similarity(held, shingles(text, words)) >= least)
            yield frame.loc[keep, ["a", "b"]]

    dealt = written(pairs.withColumn("part", F.pmod(F.hash("b"), F.lit(PARTS))))
    other = dealt.join(texts.withColumnRenamed("node", "b"), "b")
    one = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("node", "a"), "a")
    each = one.withColumn("b", F.lit("")).unionByName(other)
    # the text a comes first, as its b is empty
    return each.repartition("a", "part").sortWithinPartitions("a", "part", "b").select("a", "b", "text").mapInPandas(
        run, "a string, b string"
    )
