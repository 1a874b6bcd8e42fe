"""Boosted trees against plain boosting of whole rows in numpy."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from tablewright.operators import boosting
from tablewright.operators import modelling as Mo
from tablewright.operators.boosting import BoostedTrees

RATE, SHRINK, MIN = 0.25, 1.0, 5


def grown(x, g, h, depth, leaves):
    """Leaves (rows, value) of one tree, best leaf first, over whole rows."""
    def split(rows, level):
        if level == depth:
            return None
        score = lambda r: g[r].sum() ** 2 / (h[r].sum() + SHRINK)
        best = None
        for f in range(x.shape[1]):
            gone = np.isnan(x[rows, f])
            for cut in np.unique(x[rows, f][~gone]):
                for gone_left in (True, False):
                    left = np.where(gone, gone_left, x[rows, f] <= cut)
                    a, b = rows[left], rows[~left]
                    if len(a) < MIN or len(b) < MIN:
                        continue
                    gain = score(a) + score(b) - score(rows)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, a, b)
        return best

    open_ = [(np.arange(len(x)), 0, split(np.arange(len(x)), 0))]
    while len(open_) < leaves:
        able = [o for o in open_ if o[2] is not None]
        if not able:
            break
        one = max(able, key=lambda o: o[2][0])
        open_ = [o for o in open_ if o is not one]
        open_ += [(r, one[1] + 1, split(r, one[1] + 1)) for r in one[2][1:]]
    return [(rows, -RATE * g[rows].sum() / (h[rows].sum() + SHRINK)) for rows, _, _ in open_]


def plain(x, y, classes, rounds, depth, leaves):
    margins = np.tile(np.log(np.bincount(y, minlength=classes) / len(y)), (len(y), 1))
    counts = []
    for _ in range(rounds):
        p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
        added = np.zeros_like(margins)
        for k in range(classes):
            found = grown(x, p[:, k] - (y == k), p[:, k] * (1 - p[:, k]), depth, leaves)
            counts.append(sorted(len(r) for r, _ in found))
            for rows, value in found:
                added[rows, k] = value
        margins += added
    return np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True), counts


def data(n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.integers(0, 7, n), rng.integers(0, 20, n)]).astype(float)
    y = ((x[:, 0] > 5).astype(int) + (x[:, 1] * x[:, 2] > 30) + (rng.random(n) < 0.1)) % 3
    x[rng.random(x.shape) < 0.1] = math.nan
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, Vectors.dense(r), float(k)) for i, (r, k) in enumerate(zip(x.tolist(), y))], ["i", "features", "label"])


@pytest.mark.parametrize("rounds,depth,leaves", [(6, 3, 7), (1, 2, 4), (1, 3, 4)])
def test_equals_plain_boosting(spark, rounds, depth, leaves):
    x, y = data()
    df = frame(spark, x, y).repartition(3)
    # six rounds are more than are kept in tasks, so that margins are written once
    model = BoostedTrees(rounds=rounds, depth=depth, leaves=leaves, min_rows=MIN).fit(df)
    want, counts = plain(x, y, 3, rounds, depth, leaves)
    made = {}
    for r, k, node, feature, *_, rows, _ in model.nodes():
        if feature < 0:
            made.setdefault((r, k), []).append(rows)
    assert [sorted(v) for _, v in sorted(made.items())] == counts
    assert max(len(c) for c in counts) <= leaves
    got = {r.i: r for r in model.transform(df).select("i", "prediction", vector_to_array("probability").alias("p")).collect()}
    assert np.allclose([got[i].p for i in range(len(x))], want, atol=1e-6)
    assert [got[i].prediction for i in range(len(x))] == want.argmax(axis=1).tolist()


def test_trees_do_not_depend_on_how_rows_are_dealt(spark):
    x, y = data(seed=4)
    made = [BoostedTrees(rounds=2, min_rows=MIN).fit(frame(spark, x, y).repartition(n)).nodes() for n in (1, 5)]
    assert made[0] == made[1]


def test_numbers_and_many_values(spark):
    rng = np.random.default_rng(2)
    x = rng.random((2000, 2))
    y = np.where(x[:, 0] > 0.5, 1e6, -1e6) + 1e5 * x[:, 1]
    df = frame(spark, x, y)
    model = BoostedTrees(rounds=10, loss="squared").fit(df)
    got = np.array([r.prediction for r in model.transform(df).orderBy("i").collect()])
    assert 1 - ((got - y) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.99
    assert all(math.isfinite(n[4]) for n in model.nodes())


def test_saved_in_a_pipeline(spark, tmp_path):
    x, y = data(120)
    df = frame(spark, x, y)
    model = Pipeline(stages=[BoostedTrees(rounds=2, min_rows=MIN)]).fit(df)
    model.save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m")
    assert again.stages[0].nodes() == model.stages[0].nodes()
    assert again.transform(df).select("prediction").collect() == model.transform(df).select("prediction").collect()


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [(Vectors.dense([nan, 1.0]), 0.0), (Vectors.dense([inf, 1.0]), 0.0), (Vectors.dense([5.0, 1.0]), 2.0)] * 10
    df = spark.createDataFrame([*rows, (Vectors.dense([9.0, 9.0]), None), (Vectors.dense([9.0, 9.0]), nan)], ["features", "label"])
    model = BoostedTrees(rounds=3, min_rows=2).fit(df)
    # the first split parts present values from missing ones; class 1 has no rows
    assert [n[3] for n in model.nodes() if n[:3] == (0, 0, 1)] == [0]
    found = {(str(r.features), r.prediction) for r in model.transform(df).collect()}
    assert ("[nan,1.0]", 0.0) in found and ("[inf,1.0]", 0.0) in found and ("[5.0,1.0]", 2.0) in found
    # one class, and vectors without features
    alone = spark.createDataFrame([(Vectors.dense([]), 0.0)] * 3, ["features", "label"])
    assert {r.prediction for r in BoostedTrees().fit(alone).transform(alone).collect()} == {0.0}
    with pytest.raises(ValueError, match="no labelled rows"):
        BoostedTrees().fit(df.where("label > 9"))
    with pytest.raises(ValueError, match="whole numbers"):
        BoostedTrees().fit(df.withColumn("label", df["label"] - 0.5))
    with pytest.raises(ValueError, match="unknown settings"):
        BoostedTrees(leafs=3)


def test_pipelines_of_each_task(spark, monkeypatch):
    monkeypatch.setattr(Mo, "ROUNDS", 2)
    df = spark.createDataFrame([(float(i % 3), f"c{i % 3}", 2.0 * (i % 3)) for i in range(90)], ["x", "kind", "y"])
    for target, task in (("kind", "classification"), ("y", "regression")):
        (pipeline,) = Mo.build_pipeline({"x": 0}, [target], task, "boosted")
        assert pipeline.getStages()[-1].settings()["leaves"] == 7
        found = pipeline.fit(df).transform(df)
        labels = [f"{target}_index"] if task == "classification" else [target]
        value = Mo.score(found, labels, [f"{target}_predicted"], task).first()["score"]
        assert value == 1.0 if task == "classification" else value > 0.5


def test_equal_rows_are_one_row_with_their_number(spark):
    rng = np.random.default_rng(7)
    few = [([float(a), float(b)], float((a + b) % 3)) for a, b in rng.integers(0, 4, (40, 2)).tolist()]
    rows = spark.createDataFrame(few * 50, "features array<double>, label double").repartition(5)
    coded = boosting._coded(rows, [np.arange(3.0)] * 2, [0.0] * 3, 63).collect()
    assert len(coded) == len({(tuple(f), y) for f, y in few}) and sum(r["n"] for r in coded) == 2000
    huge = rng.integers(-(2**60), 2**60, 6)
    assert boosting._bincount(np.array([0, 1, 1, 3, 3, 3]), huge, 4).tolist() == [huge[0], huge[1] + huge[2], 0, huge[3:].sum()]
