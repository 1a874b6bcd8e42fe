"""Near-duplicates by SimHash with a hierarchical index in Gray order.

A text's fingerprint has the bits that are set in over half of the hashes of
its word shingles. Two texts are linked if their fingerprints differ in
``LIMIT`` bits at most, and a group is what links reach.

*Upper nodes.* Only distinct fingerprints are indexed, so exact copies cost one
row. The 64 bits are cut into blocks, and fingerprints within ``LIMIT`` bits
agree on some choice of ``blocks - LIMIT`` of them. Each choice is a mask, and a
mask with the bits that its members share is an upper node: members of one node
meet in one task, and no link is lost. More masks with more bits are used as
fingerprints get more, so nodes stay small.

*Inside a node.* Members are sorted by the rank of the fingerprint in Gray order,
where neighbours differ in few bits, and a tree is built over them: a tree node
keeps the bits that all below it share and that its parent does not. A search
adds up the differences on the way down and drops a whole subtree where the sum
passes the limit. Members that were reached leave the tree, so a dense group is
walked once and gives one link per member, not one per pair.

Groups are the connected components over all nodes' links.

Null and empty texts have fingerprint zero and are linked like any other. A
group's name is the smallest doc_id in it; rows with a null doc_id are linked
but name no group. Repeated rows are copies. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import minhash
from tablewright.llm.common import map_exactly, text_or_empty
from tablewright.llm.components import components
from tablewright.session import durable, scratch, written

WORDS = 4
SEED = 42
LIMIT = 4
#: Members below which a node's tree is a single leaf.
LEAF = 32
FAN = 8
#: Searches that go down the tree together.
TOGETHER = 64
#: Pairs of a search and a leaf that are compared at once.
LEAVES = 8_192
#: Members that a node should have at most, on average.
NODE_ROWS = 64
BLOCK = 100_000


def fingerprint(text: str, words: int = WORDS) -> int:
    """The 64-bit fingerprint of a whole text, as a signed number."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    width = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - width + 1], ends[width - 1 :]
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), BLOCK):
        digests = b"".join([
            xxhash.xxh64_digest(joined[a:b], SEED)
            for a, b in zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)
        ])
        bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(starts)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every document."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "fp": np.array([fingerprint(t, words) for t in frame["text"]], dtype=np.int64),
            })

    kind = dict(docs.dtypes)["doc_id"]
    return map_exactly(docs.select("doc_id", text_or_empty().alias("text")), run, f"doc_id {kind}, fp long")


def masks(rows: int, limit: int = LIMIT) -> list[int]:
    """Masks of which two fingerprints within ``limit`` bits share one; longer ones for more rows."""
    for kept in range(1, 64 - limit):
        blocks = limit + kept
        edges = [64 * i // blocks for i in range(blocks + 1)]
        if rows <= NODE_ROWS << (64 * kept // blocks) or kept == 4:
            break
    whole = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(some) for some in combinations(whole, kept)]


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each 64-bit value in the reflected Gray order."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayTree:
    """Shared bits of runs of Gray-sorted fingerprints, level by level."""

    def __init__(self, sorted_values: np.ndarray):
        self.values = sorted_values
        self.alive = np.ones(len(sorted_values), dtype=bool)
        ones, zeros = [], []
        a = o = sorted_values
        size = LEAF
        while True:
            starts = np.arange(0, len(a), size)
            a, o = np.bitwise_and.reduceat(a, starts), np.bitwise_or.reduceat(o, starts)
            ones.append(a)
            zeros.append(~o)
            if len(a) == 1:
                break
            size = FAN
        # from the root down: the bits that a node shares and its parent does not, and their pattern
        self.levels = []
        above = np.zeros(1, dtype=np.uint64)
        for depth, (one, zero) in enumerate(zip(reversed(ones), reversed(zeros), strict=True)):
            shared = one | zero
            parent = above[np.arange(len(one)) // FAN] if depth else above
            self.levels.append((one, shared & ~parent))
            above = shared

    def reached(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) pairs within the limit among the members still in the tree."""
        live = [np.add.reduceat(self.alive, np.arange(0, len(self.alive), LEAF)) > 0]
        while len(live[-1]) > 1:
            live.append(np.add.reduceat(live[-1], np.arange(0, len(live[-1]), FAN)) > 0)
        live.reverse()
        query, node = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
        gone = np.zeros(len(queries), dtype=np.int64)
        for depth, (one, own) in enumerate(self.levels):
            if depth:
                child = (node[:, None] * FAN + np.arange(FAN)).ravel()
                query, gone = np.repeat(query, FAN), np.repeat(gone, FAN)
                fits = child < len(one)
                query, gone, node = query[fits], gone[fits], child[fits]
            gone = gone + np.bitwise_count((queries[query] ^ one[node]) & own[node])
            keep = (gone <= limit) & live[depth][node]
            query, gone, node = query[keep], gone[keep], node[keep]
        found = [(query[:0], node[:0])]
        for at in range(0, len(node), LEAVES):
            member = (node[at : at + LEAVES, None] * LEAF + np.arange(LEAF)).ravel()
            of = np.repeat(query[at : at + LEAVES], LEAF)
            fits = member < len(self.values)
            of, member = of[fits], member[fits]
            keep = self.alive[member]
            of, member = of[keep], member[keep]
            near = np.bitwise_count(queries[of] ^ self.values[member]) <= limit
            found.append((of[near], member[near]))
        of, member = (np.concatenate(x) for x in zip(*found, strict=True))
        return of, member


def node_links(values: np.ndarray, limit: int = LIMIT) -> Iterator[tuple[int, int]]:
    """One link (member, first of its group) for each further member of a group in one upper node."""
    values = values[np.argsort(gray_rank(values), kind="stable")]
    tree = GrayTree(values)
    for first in range(len(values)):
        if not tree.alive[first]:
            continue
        tree.alive[first] = False
        waiting = np.array([first])
        while len(waiting):
            some, waiting = waiting[:TOGETHER], waiting[TOGETHER:]
            _, found = tree.reached(values[some], limit)
            found = np.unique(found)
            tree.alive[found] = False
            for member in found:
                yield int(values[member]), int(values[first])
            waiting = np.concatenate([waiting, found])


def small_links(node: np.ndarray, values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in single-leaf nodes, for all of them at once; ``node`` is sorted."""
    left, right = [], []
    for step in range(1, LEAF):
        same = node[step:] == node[:-step]
        if not same.any():
            break
        near = same & (np.bitwise_count(values[step:] ^ values[:-step]) <= limit)
        left.append(values[step:][near])
        right.append(values[:-step][near])
    empty = np.empty(0, dtype=np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold the same groups together, one for each member but the first."""
    names, ids = np.unique(np.concatenate([left, right]), return_inverse=True)
    above = list(range(len(names)))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for a, b in zip(ids[: len(left)].tolist(), ids[len(left) :].tolist(), strict=True):
        a, b = top(a), top(b)
        if a != b:
            above[max(a, b)] = min(a, b)
    roots = np.array([top(x) for x in range(len(names))], dtype=np.int64)
    moved = np.nonzero(roots != np.arange(len(names)))[0]
    return names[moved], names[roots[moved]]


def links(distinct: DataFrame, rows: int, limit: int = LIMIT) -> DataFrame:
    """(a, b): links that connect all fingerprints (column fp) within the limit."""
    chosen = masks(rows, limit)
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")).alias("bits"))
        for i, m in enumerate(chosen)
    ])).alias("node")).select("node.mask", "node.bits", "fp")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            edge = (frame["mask"].to_numpy()[1:] != frame["mask"].to_numpy()[:-1]) | (
                frame["bits"].to_numpy()[1:] != frame["bits"].to_numpy()[:-1]
            )
            starts = np.concatenate([[0], np.nonzero(edge)[0] + 1])
            # the last node may go on in the next batch
            held = frame.iloc[starts[-1] :] if len(frame) else None
            yield from grouped(frame.iloc[: starts[-1]], starts[:-1])
        if held is not None and len(held):
            yield from grouped(held, np.array([0]))

    def grouped(frame: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        if not len(frame):
            return
        values = frame["fp"].to_numpy().view(np.uint64)
        sizes = np.diff(np.concatenate([starts, [len(frame)]]))
        node = np.repeat(np.arange(len(starts)), sizes)
        small = (sizes <= LEAF)[node]
        left, right = forest(*small_links(node[small], values[small], limit))
        pairs = [p for i in np.nonzero(sizes > LEAF)[0] for p in node_links(values[starts[i] : starts[i] + sizes[i]], limit)]
        big = np.array(pairs, dtype=np.uint64).reshape(-1, 2)
        yield pd.DataFrame({
            "a": np.concatenate([left, big[:, 0]]).view(np.int64), "b": np.concatenate([right, big[:, 1]]).view(np.int64),
        })

    return keyed.repartition("mask", "bits").sortWithinPartitions("mask", "bits").mapInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) for every document."""
    marked = durable(fingerprints(docs, words))
    distinct = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    groups = components(links(distinct.select("fp"), distinct.count(), limit))
    rooted = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("component", "fp")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(column: str = "fp"):
    """A fingerprint as 16 lowercase digits."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def text_links(docs: DataFrame, words: int = minhash.WORDS, limit: int = LIMIT) -> DataFrame:
    """(a, b): links between the distinct texts (``minhash.text_key``) that connect all fingerprints within the limit."""
    named = docs.select(minhash.text_key().alias("doc_id"), "text")
    marked = written(fingerprints(named, words).distinct())
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = links(distinct.select("fp"), distinct.count(), limit)
    for side in ("a", "b"):
        of = distinct.select(F.col("fp").alias(side), F.col("first").alias(f"first_{side}"))
        found = found.join(of, side)
    near = found.select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    same = marked.join(distinct, "fp").where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    return written(near.unionByName(same).distinct())


def one_of_each_group(docs: DataFrame, words: int = minhash.WORDS, least: float = minhash.SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of near copies.

    Near copies share 80 % of their 5-word shingles. The index links texts whose
    fingerprints differ in ``LIMIT`` bits at most, and the exact shares confirm these
    links. Near copies often differ in more bits, up to 12: ``minhash`` finds candidates
    among texts that the index leaves apart.
    The row with the smallest doc_id stays, nulls last; among rows of that doc_id
    one text, and of its repeated rows the one whose columns come first.
    """
    with scratch(docs.sparkSession):
        groups = minhash.similar_groups(docs, words, least, known=text_links(docs, words))
        rows = docs.select("doc_id", minhash.text_key().alias("node")).groupBy("doc_id", "node").agg(F.count("*").alias("rows"))
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "rows")
        chosen = written(
            rows.join(groups, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min(order).alias("first"))
            .select(F.col("first.doc_id").alias("_id"), F.col("first.node").alias("_node"), F.col("first.rows").alias("_rows")),
            "chosen", keep=True,
        )

    def of(some: DataFrame) -> DataFrame:
        return docs.join(some, F.col("doc_id").eqNullSafe(F.col("_id")) & (minhash.text_key() == F.col("_node")))

    stays = of(chosen.where("_rows = 1")).select(*docs.columns)
    repeated = chosen.where("_rows > 1")
    if not repeated.isEmpty():
        one = of(repeated).groupBy("_id", "_node").agg(F.min(F.struct(*docs.columns)).alias("_row"))
        stays = stays.unionByName(one.select("_row.*"))
    return stays
