import math

import numpy as np
from pyspark.sql import functions as F

from tablewright.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, list long"


def plain(rows, k):
    ids = np.array([r[0] for r in rows])
    points = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    out = {}
    for q in np.nonzero(ids % 20 == 0)[0]:
        scores = (points * points[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(scores[i])) for i in order]
    return out


def test_recall_and_order(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(3000, 24)) * rng.uniform(0.5, 2, (3000, 1))
    points[500:900] = points[500] + rng.normal(size=(400, 24)) * 0.02
    points[1000:1300] = points[1000] * 3
    rows = [(i, [float(x) for x in p], 0, "x", 1) for i, p in enumerate(points)]
    got = ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 20).collect()
    want = plain(rows, 20)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = sum(len({v for _, v, _ in found[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    for q in want:
        ranks = sorted(found[q])
        assert [r for r, _, _ in ranks] == list(range(1, 21))
        assert ranks == [(i + 1, v, s) for i, (v, s) in enumerate(sorted(((v, s) for _, v, s in ranks), key=lambda x: (-x[1], x[0])))]
    assert [v for _, v, _ in sorted(found[1040])] == [i for i in range(1000, 1300) if i != 1040][:20]


def test_rows_that_take_no_part(spark):
    rows = [
        (0, [1.0, 0.0], 0, "x", 1), (20, [0.0, 0.0], 0, "x", 1), (40, None, 0, "x", 1), (60, [math.nan, 1.0], 0, "x", 1),
        (80, [None, 1.0], 0, "x", 1), (100, [math.inf, 1.0], 0, "x", 1), (None, [1.0, 1.0], 0, "x", 1), (3, [0.5, 1.0], 0, "x", 1),
        (2, [0.5, -1.0], 0, "x", 1), (4, [-1.0, 0.0], 0, "x", 1),
    ]
    vectors = spark.createDataFrame(rows, SCHEMA)
    got = ann.search(vectors, F.col("vec_id") % 20 == 0, 20).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 2, 0.5), (0, 2, 3, 0.5), (0, 3, 4, -1.0)]
    assert ann.search(vectors.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0
