"""Gradient boosting of small trees over histograms, for many classes or a number.

One model holds one tree a class and round (softmax gradients), or one tree a round
(squared loss). Values are cut once into at most ``bins`` ranges and rows are kept as
one byte a feature, a label and the margins. Rows that agree in their ranges and label
keep equal margins, so they are one row with its number, which is exact and leaves few
rows of a long table with few values. A level of all trees of a round is one
grouped aggregate: every task adds gradients up by (tree, node, feature, range), the
sums are combined by key, and the best split of each open node is found by windows
over its ranges. The driver sees one row an open node, never a histogram or a row of
the table. Every ``CUT`` rounds the margins are written to the shared folder; until
then tasks add the few trees since.

Trees grow best leaf first up to ``leaves``, none deeper than ``depth``. As a split
changes no other leaf, the levels are searched in full and the order of gains then
says which splits stay. Gradients are summed as whole numbers of 2**-30, so the sums
and the trees do not depend on how rows are dealt, and reruns agree.

Null, NaN and infinite values are missing: each split sends them to the side of
greater gain (left on ties). Rows without a label are left out of the fit. Ties of
gain go to the first feature, then the lowest cut. Without labelled rows the fit raises
ValueError; without features, or where no split helps, the model is the share of each
class, or the mean. A task holds 24 bytes x trees x open nodes x features x ranges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import durable

#: Whole numbers to one unit of gradient.
UNIT = 2.0**30
#: Rounds after which margins are written, and features that a task counts at once.
CUT, BLOCK = 5, 256
DEFAULTS = {"rounds": 30, "depth": 3, "leaves": 7, "rate": 0.25, "bins": 63, "min_rows": 20, "shrink": 1.0, "loss": "softmax"}


@dataclass
class Tree:
    """Nodes by heap number: 1 is the root, 2i and 2i + 1 are the children of i; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    rows: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1)
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool), np.zeros(n), np.zeros(n, np.int64), np.zeros(n))

    def leaf_of(self, values: np.ndarray, missing: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The node that each row ends in; ``cuts`` are the nodes' cuts in the terms of ``values``."""
        node = np.ones(len(values), np.int64)
        every = np.arange(len(values))
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return node
            at = np.where(inner, feature, 0)
            right = np.where(missing[every, at], ~self.missing_left[node], values[every, at] > cuts[node])
            node = np.where(inner, 2 * node + right, node)

    def as_rows(self) -> list[list]:
        """One list a node that is in use."""
        used, todo = [], [1]
        while todo:
            i = todo.pop()
            used.append([
                i, int(self.feature[i]), float(self.threshold[i]), bool(self.missing_left[i]), float(self.value[i]),
                int(self.rows[i]), float(self.gain[i]),
            ])
            if self.feature[i] >= 0:
                todo += [2 * i, 2 * i + 1]
        return sorted(used)

    @classmethod
    def from_rows(cls, rows: list[list]) -> Tree:
        tree = cls.empty(max(r[0] for r in rows).bit_length() - 1)
        for i, feature, threshold, left, value, n, gain in rows:
            tree.feature[i], tree.threshold[i], tree.missing_left[i] = feature, threshold, left
            tree.value[i], tree.rows[i], tree.gain[i] = value, n, gain
        return tree


def _softmax(margins: np.ndarray) -> np.ndarray:
    up = np.exp(margins - margins.max(axis=1, keepdims=True))
    return up / up.sum(axis=1, keepdims=True)


def _gradients(margins: np.ndarray, label: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss by margin, in whole units."""
    if loss == "squared":
        return np.rint((margins - label[:, None]) * UNIT), np.full(margins.shape, UNIT)
    share = _softmax(margins)
    second = np.rint(share * (1 - share) * UNIT)
    share[np.arange(len(label)), label.astype(np.int64)] -= 1
    return np.rint(share * UNIT), second


def _bincount(cell: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of whole numbers by cell."""
    if len(weight) * int(np.abs(weight).max(initial=0)) < 2**53:
        return np.bincount(cell, weight, size).astype(np.int64)
    # a double holds the sum of the halves, not that of the numbers
    high, low = np.bincount(cell, weight >> 26, size), np.bincount(cell, weight & (2**26 - 1), size)
    return (high.astype(np.int64) << 26) + low.astype(np.int64)


def _read(frame: pd.DataFrame, width: int, missing: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(frame["codes"]), np.uint8).reshape(len(frame), width)
    return codes, codes == missing, np.stack(frame["margins"].to_numpy()).copy()


def _add(margins: np.ndarray, codes: np.ndarray, missing: np.ndarray, trees: list[list[Tree]]) -> np.ndarray:
    for made in trees:
        for k, tree in enumerate(made):
            margins[:, k] += tree.value[tree.leaf_of(codes, missing, tree.cut)]
    return margins


def ranges(values: DataFrame, bins: int) -> list[np.ndarray]:
    """Upper borders of the ranges of each feature of ``features`` (array<double>, missing as null).

    A feature of few values has one range a value, any other one the quantiles.
    """
    width = values.agg(F.max(F.size("features"))).first()[0] or 0
    cells = values.select(F.posexplode("features").alias("feature", "value")).where("value IS NOT NULL")
    steps = [i / bins for i in range(1, bins)]
    found = cells.groupBy("feature").agg(
        F.percentile_approx("value", steps, 10_000).alias("steps"), F.approx_count_distinct("value", 0.02).alias("n")
    )
    # two small rows a feature
    rows = found.collect()
    few = [r["feature"] for r in rows if r["n"] <= 2 * bins]
    single: dict[int, list[float]] = {}
    if few:
        listed = cells.where(F.col("feature").isin(few)).groupBy("feature", "value").count()
        for r in listed.groupBy("feature").agg(F.sort_array(F.collect_list("value")).alias("all")).collect():
            single[r["feature"]] = r["all"]
    out = [np.zeros(0)] * width
    for r in rows:
        some = single.get(r["feature"], [])
        out[r["feature"]] = np.array(some[:-1]) if 0 < len(some) <= bins else np.unique(r["steps"])
    return out


def _coded(rows: DataFrame, borders: list[np.ndarray], start: list[float], missing: int) -> DataFrame:
    """(codes, label, n, margins): the range of each feature as one byte, and the rows that have them."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            values = np.stack(frame["features"].to_numpy()).astype(float)
            codes = np.empty(values.shape, np.uint8)
            for j, border in enumerate(borders):
                codes[:, j] = np.where(np.isnan(values[:, j]), missing, np.searchsorted(border, values[:, j], side="left"))
            yield pd.DataFrame({"codes": [c.tobytes() for c in codes], "label": frame["label"]})

    coded = rows.select("features", "label").mapInPandas(run, "codes binary, label double")
    return coded.groupBy("codes", "label").agg(F.count("*").alias("n")).withColumn("margins", F.array(*map(F.lit, start)))


def _histograms(
    rows: DataFrame, since: list[list[Tree]], growing: list[Tree], places: np.ndarray, width: int, missing: int, loss: str
) -> DataFrame:
    """Sums of gradients by (tree, place of the open node, feature, code)."""
    trees, slots, nodes = len(growing), missing + 1, int(places.max()) + 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, trees, nodes, width, slots), np.int64)
        for frame in frames:
            if not len(frame):
                continue
            codes, gone, margins = _read(frame, width, missing)
            first, second = _gradients(_add(margins, codes, gone, since), frame["label"].to_numpy(), loss)
            rows_of = frame["n"].to_numpy()
            first, second = first.astype(np.int64) * rows_of[:, None], second.astype(np.int64) * rows_of[:, None]
            for k, tree in enumerate(growing):
                place = places[k][tree.leaf_of(codes, gone, tree.cut)]
                here = place >= 0
                for low in range(0, width, BLOCK):
                    some = codes[here, low:low + BLOCK]
                    wide = some.shape[1]
                    cell = ((place[here, None] * wide + np.arange(wide)) * slots + some).ravel()
                    for m, weight in enumerate((first[here, k], second[here, k], rows_of[here])):
                        added = _bincount(cell, np.repeat(weight, wide), nodes * wide * slots)
                        total[m, k, :, low:low + wide] += added.reshape(nodes, wide, slots)
        at = np.nonzero(total[2])
        yield pd.DataFrame(dict(zip(("tree", "place", "feature", "code"), at)) | {n: total[m][at] for m, n in enumerate("ghn")})

    made = rows.mapInPandas(run, "tree int, place int, feature int, code int, g long, h long, n long")
    # whole sums over all tasks, wider than a long
    return made.groupBy("tree", "place", "feature", "code").agg(*[F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in "ghn"])


def best_splits(histograms: DataFrame, missing: int, min_rows: int, shrink: float) -> DataFrame:
    """(tree, place, g, h, n, best) of each open node; ``best`` is null where no split helps."""
    node = Window.partitionBy("tree", "place", "feature")
    upto = node.orderBy("code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    real = lambda c: (c.cast("double") / F.lit(UNIT)).cast("double")
    sums = histograms.select(
        "tree", "place", "feature", "code",
        *[F.sum(c).over(upto).alias(f"{c}_left") for c in "ghn"],
        *[F.sum(c).over(node).alias(f"{c}_all") for c in "ghn"],
        *[F.sum(F.when(F.col("code") == missing, F.col(c)).otherwise(0)).over(node).alias(f"{c}_gone") for c in "ghn"],
    )

    def score(g: Column, h: Column) -> Column:
        return F.try_divide(real(g) * real(g), real(h) + F.lit(shrink))

    def candidate(gone_left: bool) -> Column:
        left = {c: F.col(f"{c}_left") + F.col(f"{c}_gone") if gone_left else F.col(f"{c}_left") for c in "ghn"}
        right = {c: F.col(f"{c}_all") - left[c] for c in "ghn"}
        gain = score(left["g"], left["h"]) + score(right["g"], right["h"]) - score(F.col("g_all"), F.col("h_all"))
        fits = (F.col("code") < missing) & (left["n"] >= min_rows) & (right["n"] >= min_rows) & (gain > 0)
        return F.when(fits, F.struct(
            gain.alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("code")).alias("code"),
            F.lit(gone_left).alias("missing_left"), real(left["g"]).alias("g"), real(left["h"]).alias("h"),
            left["n"].cast("long").alias("n"),
        ))

    both = sums.withColumn("best", F.greatest(candidate(True), candidate(False)))
    return both.groupBy("tree", "place").agg(
        F.max("best").alias("best"), real(F.max("g_all")).alias("g"), real(F.max("h_all")).alias("h"),
        F.max("n_all").cast("long").alias("n"),
    )


def _best_first(tree: Tree, leaves: int) -> None:
    """Keep the splits that growing best leaf first makes, up to ``leaves``."""
    open_, kept = [1], set()
    while len(kept) < leaves - 1:
        able = [i for i in open_ if tree.feature[i] >= 0]
        if not able:
            break
        best = max(able, key=lambda i: (tree.gain[i], -i))
        kept.add(best)
        open_.remove(best)
        open_ += [2 * best, 2 * best + 1]
    for i in range(1, len(tree.feature)):
        if i not in kept:
            tree.feature[i] = -1


def _grow(rows: DataFrame, since: list[list[Tree]], trees: int, borders: list[np.ndarray], o: dict) -> list[Tree]:
    """The trees of one round, one aggregate a level."""
    missing, width = o["bins"], len(borders)
    growing = [Tree.empty(o["depth"]) for _ in range(trees)]
    open_ = [[1] for _ in range(trees)]
    for _ in range(o["depth"]):
        places = np.full((trees, 2 ** (o["depth"] + 1)), -1)
        for k, nodes in enumerate(open_):
            places[k, nodes] = np.arange(len(nodes))
        if places.max() < 0:
            break
        sums = _histograms(rows, since, growing, places, width, missing, o["loss"])
        following: list[list[int]] = [[] for _ in range(trees)]
        # one row an open node
        for r in best_splits(sums, missing, o["min_rows"], o["shrink"]).collect():
            tree, i, best = growing[r["tree"]], open_[r["tree"]][r["place"]], r["best"]
            tree.rows[i], tree.value[i] = r["n"], -o["rate"] * r["g"] / (r["h"] + o["shrink"])
            if best is None:
                continue
            feature, code = -best["feature"], -best["code"]
            tree.feature[i], tree.cut[i], tree.gain[i], tree.missing_left[i] = feature, code, best["gain"], best["missing_left"]
            # all values are left of the last range's border, missing ones right of it
            tree.threshold[i] = borders[feature][code] if code < len(borders[feature]) else np.finfo(float).max
            for child, g, h, n in (
                (2 * i, best["g"], best["h"], best["n"]),
                (2 * i + 1, r["g"] - best["g"], r["h"] - best["h"], r["n"] - best["n"]),
            ):
                tree.rows[child], tree.value[child] = n, -o["rate"] * g / (h + o["shrink"])
                following[r["tree"]].append(child)
        open_ = [sorted(nodes) for nodes in following]
    for tree in growing:
        _best_first(tree, o["leaves"])
    return growing


class _Names(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vectors", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "class index from 0, or a number", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "likeliest class, or the number", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "share of each class", TypeConverters.toString)
    options = Param(Params._dummy(), "options", "further settings as JSON", TypeConverters.toString)

    def _names(self, features, label, prediction, probability, **options):
        wrong = set(options) - set(DEFAULTS)
        if wrong:
            raise ValueError(f"unknown settings {sorted(wrong)}")
        self._set(featuresCol=features, labelCol=label, predictionCol=prediction, probabilityCol=probability, options=json.dumps(DEFAULTS | options))

    def settings(self) -> dict:
        return json.loads(self.getOrDefault(self.options))

    def _features(self) -> Column:
        """Numbers of the vector, null where missing."""
        name = f"`{self.getOrDefault(self.featuresCol)}`"
        bad = lambda v: F.isnan(v) | (F.abs(v) == float("inf"))
        return F.transform(vector_to_array(F.col(name)), lambda v: F.when(~bad(v), v))


class BoostedTrees(Estimator, _Names, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator over a vector column; ``loss`` is "softmax" (classes 0, 1, 2 ...) or "squared"."""

    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability", **options):
        super().__init__()
        self._names(featuresCol, labelCol, predictionCol, probabilityCol, **options)
        o = self.settings()
        if not 2 <= o["bins"] <= 255 or o["depth"] < 1 or o["leaves"] < 2 or o["min_rows"] < 1 or o["loss"] not in ("softmax", "squared"):
            raise ValueError("bins are 2 to 255, depth and min_rows from 1, leaves from 2, loss softmax or squared")

    def _start(self, rows: DataFrame, loss: str) -> tuple[list[float], float]:
        """Margins before the first round, and the number that a label is divided by."""
        if loss == "squared":
            mean, low, high = rows.agg(F.avg("label"), F.min("label"), F.max("label")).first()
            if mean is None:
                raise ValueError("no labelled rows")
            return [mean], max(high - mean, mean - low) or 1.0
        wrong = (F.col("label") < 0) | (F.col("label") != F.floor("label"))
        top, n, bad = rows.agg(F.max("label"), F.count("*"), F.count_if(wrong)).first()
        if not n:
            raise ValueError("no labelled rows")
        if bad:
            raise ValueError("classes are whole numbers from 0")
        counts = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
        # a class without rows starts as if it had half a row
        return [float(np.log(max(counts.get(k, 0), 0.5) / n)) for k in range(int(top) + 1)], 1.0

    def _fit(self, df: DataFrame) -> BoostedTreesModel:
        o = self.settings()
        label = F.col(f"`{self.getOrDefault(self.labelCol)}`").cast("double")
        rows = df.select(label.alias("label"), self._features().alias("features")).where(
            "label IS NOT NULL AND NOT isnan(label) AND abs(label) < double('Infinity')"
        )
        start, scale = self._start(rows, o["loss"])
        borders = ranges(rows, o["bins"])
        made: list[list[Tree]] = []
        if borders:
            # a number is learned as its distance from the mean, at most one
            learned = rows if o["loss"] == "softmax" else rows.withColumn("label", (F.col("label") - start[0]) / scale)
            first = start if o["loss"] == "softmax" else [0.0]
            coded = durable(_coded(learned, borders, first, o["bins"]))
            since: list[list[Tree]] = []
            for _ in range(o["rounds"]):
                trees = _grow(coded, since, len(start), borders, o)
                if all(t.feature[1] < 0 for t in trees):
                    break
                made.append(trees)
                since.append(trees)
                if len(since) == CUT:
                    coded, since = durable(_moved(coded, since, len(borders), o["bins"])), []
        state = {"start": start, "scale": scale, "trees": [[t.as_rows() for t in trees] for trees in made]}
        names = [self.getOrDefault(p) for p in (self.featuresCol, self.labelCol, self.predictionCol, self.probabilityCol)]
        return BoostedTreesModel(*names, state=state, **o)


def _moved(rows: DataFrame, since: list[list[Tree]], width: int, missing: int) -> DataFrame:
    """Rows with the trees added to their margins."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                codes, gone, margins = _read(frame, width, missing)
                yield frame.assign(margins=list(_add(margins, codes, gone, since)))

    return rows.mapInPandas(run, rows.schema)


class BoostedTreesModel(Model, _Names, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the prediction, and for classes their probabilities; saved and loaded as parameters."""

    state = Param(Params._dummy(), "state", "start and trees as JSON", TypeConverters.toString)

    def __init__(
        self, featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability", state=None, **options
    ):
        super().__init__()
        self._names(featuresCol, labelCol, predictionCol, probabilityCol, **options)
        self._set(state=json.dumps(state or {"start": [0.0], "scale": 1.0, "trees": []}))

    def nodes(self) -> list[tuple]:
        """(round, tree, node, feature, threshold, missing_left, value, rows, gain) of every node, as trees are read."""
        kept = json.loads(self.getOrDefault(self.state))["trees"]
        return [(r, k, *node) for r, trees in enumerate(kept) for k, tree in enumerate(trees) for node in tree]

    def _transform(self, df: DataFrame) -> DataFrame:
        kept = json.loads(self.getOrDefault(self.state))
        start, scale = kept["start"], kept["scale"]
        trees = [[Tree.from_rows(t) for t in made] for made in kept["trees"]]
        softmax = self.settings()["loss"] == "softmax"

        @F.pandas_udf("array<double>")
        def scored(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            margins = np.tile(np.array(start if softmax else [0.0]), (len(vectors), 1))
            if trees:
                values = np.stack(vectors.to_numpy()).astype(float)
                gone = np.isnan(values)
                for made in trees:
                    for k, tree in enumerate(made):
                        margins[:, k] += tree.value[tree.leaf_of(values, gone, tree.threshold)]
            return pd.Series(list(_softmax(margins) if softmax else margins * scale + start[0]))

        out, share = self.getOrDefault(self.predictionCol), self.getOrDefault(self.probabilityCol)
        made = df.withColumn("__scored", scored(self._features()))
        if softmax:
            top = F.array_position(F.col("__scored"), F.array_max("__scored")) - 1
            made = made.withColumn(share, array_to_vector("__scored")).withColumn(out, top.cast("double"))
        else:
            made = made.withColumn(out, F.col("__scored")[0])
        return made.drop("__scored")
