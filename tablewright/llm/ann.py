"""Nearest neighbours by inner product with balanced posting lists.

*Index.* A bounded sample of vectors is halved again and again, by the median
of the difference to two means, into equal parts; their means are the
centroids. Every vector is posted to the list of its nearest centroid, and a
boundary vector, one that is about as near to others, to those lists as well
(``NEAR``, up to ``COPIES`` lists). Centroids are found through an in-memory
graph that links each to its nearest ones, by best-first search.

*Search.* A query walks the graph and reads the lists whose centroid is at most
``RATIO`` times as far as its nearest one. A query inside a dense group so reads
few lists and one far from everything reads many; lists are added until they
surely hold as many vectors as are asked for. Inside a list, scores are
exact. ``recall`` measures the result against brute force.

Inner products become distances by one more component that brings all vectors
to the same length; queries get a zero there.

Vectors that are null or zero, or hold a null or a component that is not
finite, take no part, on either side. All others must have one length. Ties go
to the smaller vec_id, exact copies of a vector among them, because scores of
equal vectors are summed alike. Rows that repeat a vec_id are different
candidates only if their vectors differ in score. An empty table gives no rows.

A task compares a bucket: some small lists, or a chunk of a large one, with a
bounded number of vectors and of queries, and gives one answer for each query. A
list that holds a third of all rows is many tasks' work. The sample (at most
``SAMPLE`` vectors, by hash of vec_id) is fitted on the driver; every row is
indexed. Only centroids, at most ``LISTS``, are sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import durable

SAMPLE = 20_000
LISTS = 2_048
LIST_ROWS = 400
NEAR = 1.05
COPIES = 4
RATIO = 1.16
LINKS = 16
BEAM = 48
#: Vectors, and queries of one list, that one task compares.
CHUNK = 16_384
QUERY_CHUNK = 2_048
#: Slack for the first pass over scores, whose last bits depend on the order of sums.
SLACK = 1e-9


@dataclass
class Centroids:
    """Centroids with the graph that links near ones."""

    points: np.ndarray
    links: np.ndarray
    entry: int

    def search(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the ``beam`` nearest centroids that a best-first walk finds, nearest first."""
        count, beam = len(self.points), min(beam, len(self.points))
        rows = np.arange(len(vectors))
        norms = (self.points**2).sum(axis=1)

        def distance(which: np.ndarray) -> np.ndarray:
            dots = np.einsum("ijk,ik->ij", self.points[which], vectors)
            return np.sqrt(np.maximum(0.0, norms[which] - 2 * dots + (vectors**2).sum(axis=1)[:, None]))

        met = np.zeros((len(vectors), count + 1), dtype=bool)
        met[:, count] = True
        ids = np.full((len(vectors), beam), count)
        far = np.full((len(vectors), beam), np.inf)
        done = np.ones((len(vectors), beam), dtype=bool)
        ids[:, 0], done[:, 0], met[:, self.entry] = self.entry, False, True
        far[:, 0] = distance(ids[:, :1])[:, 0]
        while not done.all():
            pick = np.where(done, np.inf, far).argmin(axis=1)
            active = ~done[rows, pick]
            done[rows, pick] = True
            near = np.where(active[:, None], self.links[np.minimum(ids[rows, pick], count - 1)], count)
            near = np.where(np.take_along_axis(met, near, axis=1), count, near)
            met[rows[:, None], near] = True
            gap = np.where(near < count, distance(np.minimum(near, count - 1)), np.inf)
            ids = np.concatenate([ids, near], axis=1)
            far = np.concatenate([far, gap], axis=1)
            done = np.concatenate([done, near == count], axis=1)
            order = np.argsort(far, axis=1, kind="stable")[:, :beam]
            ids, far, done = (np.take_along_axis(x, order, axis=1) for x in (ids, far, done))
        return ids, far


def halved(points: np.ndarray, most: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Equal parts of at most ``most`` points, each cut across the line between two means."""
    if len(points) <= most:
        return [points]
    means = points[rng.choice(len(points), 2, replace=False)]
    half = len(points) // 2
    for _ in range(4):
        order = np.argsort(points @ (means[1] - means[0]), kind="stable")
        means = np.stack([points[order[:half]].mean(axis=0), points[order[half:]].mean(axis=0)])
    return halved(points[order[:half]], most, rng) + halved(points[order[half:]], most, rng)


def linked(points: np.ndarray) -> Centroids:
    """The graph: nearest links, and a ring so that every centroid can be reached."""
    count = len(points)
    gaps = (points**2).sum(axis=1)[None, :] - 2 * points @ points.T
    np.fill_diagonal(gaps, np.inf)
    near = np.argsort(gaps, axis=1, kind="stable")[:, : max(1, min(LINKS, count - 1))]
    ring = np.stack([(np.arange(count) + 1) % count, (np.arange(count) - 1) % count], axis=1)
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    # a link is listed once; the number past the last centroid stands for none
    repeated = (ring[:, :, None] == near[:, None, :]).any(axis=2)
    repeated[:, 1] |= ring[:, 0] == ring[:, 1]
    return Centroids(points, np.concatenate([near, np.where(repeated, count, ring)], axis=1), entry)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return (
        vectors.select("vec_id", vector.alias("vector"))
        .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite)
        .where(F.exists("vector", lambda x: x != 0))
    )


def fit(rows: DataFrame, sample: int = SAMPLE) -> tuple[Centroids, float] | None:
    """Centroids from a bounded sample, and the length that all vectors are brought to."""
    head = rows.agg(
        F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("square"), F.count("*").alias("rows")
    ).first()
    if not head["rows"]:
        return None
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toPandas()
    points = np.stack(picked["vector"].to_numpy())
    lists = min(LISTS, max(1, head["rows"] // LIST_ROWS), len(points))
    parts = halved(lengthened(points, head["square"]), -(-len(points) // lists), np.random.default_rng(7))
    return linked(np.stack([p.mean(axis=0) for p in parts])), head["square"]


def lengthened(points: np.ndarray, square: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, square - (points**2).sum(axis=1)))
    return np.concatenate([points, rest[:, None]], axis=1)


def posted(rows: DataFrame, centroids: Centroids, square: float) -> DataFrame:
    """(list, vec_id, vector): each vector once for each list that holds it."""
    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            points = lengthened(np.stack(frame["vector"].to_numpy()), square) if len(frame) else np.empty((0, 1))
            if not len(points):
                continue
            ids, far = centroids.search(points, BEAM)
            ids, far = ids[:, :COPIES], far[:, :COPIES]
            row, nth = np.nonzero(far <= far[:, :1] * NEAR)
            yield pd.DataFrame({
                "list": ids[row, nth], "vec_id": frame["vec_id"].to_numpy()[row],
                "vector": frame["vector"].to_numpy()[row],
            })

    return rows.mapInPandas(assign, "list long, vec_id long, vector array<double>")


def routed(queries: DataFrame, centroids: Centroids, ratio: float, sizes: np.ndarray, k: int) -> DataFrame:
    """(list, vec_id, vector): each query once for each list that it reads.

    Lists are added by distance until they surely hold ``k`` other vectors.
    """
    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 512):
                some = frame.iloc[at : at + 512]
                points = np.stack(some["vector"].to_numpy())
                points = np.concatenate([points, np.zeros((len(points), 1))], axis=1)
                ids, far = centroids.search(points, len(centroids.points))
                held = np.cumsum(sizes[ids], axis=1) - sizes[ids]
                row, nth = np.nonzero(((far <= far[:, :1] * ratio) | (held <= k * COPIES)) & (ids < len(centroids.points)))
                yield pd.DataFrame({
                    "list": ids[row, nth], "vec_id": some["vec_id"].to_numpy()[row],
                    "vector": some["vector"].to_numpy()[row],
                })

    return queries.mapInPandas(route, "list long, vec_id long, vector array<double>")


def best(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best of ``vectors`` for each query, ties to the smaller id, with exact scores."""
    out = []
    points, ids = np.stack(vectors["vector"].to_numpy()), vectors["vec_id"].to_numpy()
    wanted = np.stack(queries["vector"].to_numpy())
    for at in range(0, len(queries), 256):
        some = wanted[at : at + 256]
        scores = some @ points.T
        own = queries["vec_id"].to_numpy()[at : at + 256]
        scores[own[:, None] == ids[None, :]] = -np.inf
        kth = np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(some), -np.inf)
        row, col = np.nonzero((scores >= (kth - SLACK * (1 + np.abs(kth)))[:, None]) & (scores > -np.inf))
        exact = (some[row] * points[col]).sum(axis=1)
        order = np.lexsort((ids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        keep = nth < k
        out.append(pd.DataFrame({"query_id": own[row[keep]], "vec_id": ids[col[keep]], "score": exact[keep]}))
    return pd.concat(out)


def buckets_of(sizes: np.ndarray, asked: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(list, bucket, chunks, blocks): small lists share a bucket, a large one is cut into chunks of its own.

    A bucket's queries are cut into blocks by the most that one of its lists is asked.
    """
    bucket, filled, rows = 0, 0, []
    for i in np.nonzero((sizes > 0) & (asked > 0))[0]:
        if filled and filled + sizes[i] > CHUNK:
            bucket, filled = bucket + 1, 0
        rows.append((int(i), bucket, int(-(-sizes[i] // CHUNK))))
        filled += sizes[i]
    most: dict[int, int] = {}
    for i, b, _ in rows:
        most[b] = max(most.get(b, 1), int(-(-asked[i] // QUERY_CHUNK)))
    return [(i, b, c, most[b]) for i, b, c in rows]


def search(vectors: DataFrame, is_query, k: int = 20, ratio: float = RATIO, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row that ``is_query`` picks."""
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    rows = usable(vectors)
    fitted = fit(rows, sample)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centroids, square = fitted
    lists = durable(posted(rows, centroids, square))
    sizes = counted(lists, centroids)
    asked = durable(routed(rows.where(is_query), centroids, ratio, sizes, k))
    # at most LISTS small rows
    placed = buckets_of(sizes, counted(asked, centroids))

    def cuts() -> DataFrame:
        return F.broadcast(spark.createDataFrame(placed, "list long, bucket int, chunks int, blocks int"))

    left = asked.join(cuts(), "list").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), "list", "vec_id", "vector",
    )
    right = lists.join(cuts(), "list").select(
        "bucket", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "list", "vec_id", "vector",
    )
    keys = ["bucket", "chunk", "block"]

    def nearest(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": int, "vec_id": int})]
        members = dict(tuple(candidates.groupby("list")))
        out += [best(some, members[i], k) for i, some in queries.groupby("list") if i in members]
        # the best of all lists of the bucket: one answer for each query
        both = pd.concat(out).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return both.drop_duplicates(["query_id", "vec_id"]).groupby("query_id").head(k)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, schema)
    distinct = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        distinct.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def counted(rows: DataFrame, centroids: Centroids) -> np.ndarray:
    """Rows of each list, and of none behind the last."""
    out = np.zeros(len(centroids.points) + 1, dtype=np.int64)
    for r in rows.groupBy("list").agg(F.count("*").alias("rows")).collect():
        out[r["list"]] = r["rows"]
    return out


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact (query_id, vec_id) pairs that were found."""
    hits = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi")
    total = exact.count()
    return hits.count() / total if total else 1.0
