"""Audit of how filters interact when they are applied in different orders.

What a filter removes depends on those before it. A document is stood for by the
set of filters that it fails, and an order by the place of each filter, the
inverse of its permutation. The mask matrix has 0 where a document's class fails
a filter and infinity elsewhere; combined with the matrix of places by the
min-plus product, sums replaced by minima and products by sums, it gives for each
class and order the step at which the class is removed, or none. These ranks
drive everything else: documents scattered to their steps and added up with
their weights, and at each step those that fail its filter but went before.

Documents are counted by part and class first, and a part has at most ``2**5``
classes, so the orders multiply rows of parts and never documents. Copies are
found by a digest of the whole text: the smallest doc_id of each text is taken by
a combined minimum, and rows meet it by digest and doc_id, so a large group of
copies is spread over the tasks.

A null text is empty. A null part is the empty string. Rows with a null doc_id
have no label, are never a copy and make none; rows that repeat the smallest
doc_id of a text are no copies either. Of several labels of a doc_id, each that
is 1 counts. An empty table has no parts and gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import in_slices, map_exactly, text_or_empty
from tablewright.session import durable

FILTERS = "ABCDE"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"
COUNTS = ("n", "good", "toxic")


def text_failures(text: str) -> int:
    """Bits of the filters A to D that a whole text fails."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    few = len(words) < 50
    dull = 100 * len(set(words)) < 65 * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 5 * len(text)
    signs = len(raw.translate(None, SYMBOLS)) < len(raw)
    return few | dull << 1 | loud << 2 | signs << 3


def marked(docs: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, digest, mask, n): documents by their failures of A to D; equal rows are counted."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_slices(frames):
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "part": frame["part"],
                "digest": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in frame["text"]],
                "mask": np.array([text_failures(t) for t in frame["text"]], dtype=np.int32),
            })

    sent = docs.select(
        "doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), text_or_empty().alias("text")
    )
    made = map_exactly(sent, run, f"doc_id {dict(docs.dtypes)['doc_id']}, part string, digest binary, mask int")
    return durable(made.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")))


def class_counts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters that they fail."""
    rows = marked(docs, part)
    known = rows.where(F.col("doc_id").isNotNull())
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    told = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.bool_or(F.col("quality") == 1).alias("is_good"), F.bool_or(F.col("toxic") == 1).alias("is_toxic")
    )
    copies = known.join(first, ["digest", "doc_id"], "left").withColumn(
        "mask", F.col("mask") + F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    )
    every = copies.join(told, "doc_id", "left").select("part", "mask", "n", "is_good", "is_toxic").unionByName(
        rows.where(F.col("doc_id").isNull()).select("part", "mask", "n", F.lit(False).alias("is_good"), F.lit(False).alias("is_toxic"))
    )
    return every.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("is_good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("is_toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def min_plus(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The min-plus product: the least sum over the inner axis."""
    return (left[:, None, :] + right.T[None, :, :]).min(axis=2)


class Orders:
    """All orders of some filters, and the ranks at which a class of documents is removed."""

    def __init__(self, filters: str = FILTERS):
        self.names = ["".join(p) for p in permutations(filters)]
        #: The filter of each order and step, and the step of each order and filter.
        self.filter_at = np.array(list(permutations(range(len(filters)))))
        self.place = np.argsort(self.filter_at, axis=1)
        self.width = len(filters)

    def ranks(self, masks: np.ndarray) -> np.ndarray:
        """The step, from 0, at which each mask is removed in each order; the number of filters if never."""
        fails = masks[:, None] >> np.arange(self.width) & 1
        apart = np.where(fails == 1, 0.0, np.inf)
        return np.minimum(min_plus(apart, self.place.T.astype(float)), self.width).astype(np.int64)

    def audit(self, masks: np.ndarray, counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Figures of each order and step (orders by steps) of classes with these counts."""
        rank = self.ranks(masks)
        order = np.broadcast_to(np.arange(len(self.names)), rank.shape)

        def scattered(weight: np.ndarray) -> np.ndarray:
            total = np.zeros((len(self.names), self.width + 1), dtype=np.int64)
            np.add.at(total, (order, rank), np.broadcast_to(weight[:, None], rank.shape))
            return total[:, : self.width]

        n = counts["n"]
        removed = scattered(n)
        fails = (masks[:, None] >> np.arange(self.width) & 1).astype(bool)
        before = fails[:, self.filter_at] & (rank[:, :, None] < np.arange(self.width))
        alone = np.array([n[masks == 1 << f].sum() for f in range(self.width)], dtype=np.int64)
        shares = np.array([removed[np.arange(len(removed)), self.place[:, f]].sum() for f in range(self.width)], dtype=np.int64)
        return {
            "kept": n.sum() - removed.cumsum(axis=1), "removed": removed,
            "redundant": np.tensordot(n, before.astype(np.int64), axes=1),
            "unique_fails": alone[self.filter_at], "good_lost": scattered(counts["good"]),
            "toxic_lost": scattered(counts["toxic"]), "shapley": shares[self.filter_at],
        }


FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, figures) of class counts (part, mask, n, good, toxic)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        orders = Orders(filters)
        rows = len(orders.names) * orders.width
        for frame in frames:
            for part, classes in zip(frame["part"], frame["classes"], strict=True):
                cell = np.array([[c[k] for k in ("mask", *COUNTS)] for c in classes], dtype=np.int64)
                made = orders.audit(cell[:, 0], dict(zip(COUNTS, cell.T[1:], strict=True)))
                yield pd.DataFrame({
                    "part": [part] * rows, "filter_order": np.repeat(orders.names, orders.width),
                    "step": np.tile(np.arange(1, orders.width + 1, dtype=np.int32), len(orders.names)),
                } | {k: made[k].ravel() for k in FIGURES})

    # at most 2**len(filters) classes a part
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("classes"))
    fields = ", ".join(f"{k} long" for k in FIGURES)
    return parts.mapInPandas(run, f"part string, filter_order string, step int, {fields}")
