"""Two-stage type classifier over column profiles, on Spark ML."""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (
    IDF,
    CountVectorizer,
    CountVectorizerModel,
    RegexTokenizer,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.cells import is_number
from tablewright.functions.samples import digit_columns
from tablewright.operators.infer import (
    DROP,
    STAGE_ONE,
    STAGE_TWO,
    STAGE_TWO_TYPES,
    drop_degenerate,
    normalize_text,
)

TEXT_DIMENSIONS = 70
# Every term of a vocabulary is kept.
ALL_TERMS = 2**31 - 1
# Block power iteration: further columns beside the components, and rounds.
SPARE, POWER_ROUNDS = 10, 8
MOMENTS = ["total_vals", "num_nans", "num_of_dist_val", "mean", "std_dev", "min_val", "max_val", "pct_dist_val", "pct_nans"]
SHAPE = [
    f"{p}_{m}"
    for m in ("word_count", "stopword_total", "char_count", "whitespace_count", "delim_count")
    for p in ("mean", "std_dev")
]
FLAGS = ["has_delimiters", "has_url", "has_email", "has_date", "is_list", "is_long_sentence"]
DIGITS = ["num_number_characters", "num_separated_tokens", "comma_include"]


class _TextParams(Params):
    inputCol = Param(Params._dummy(), "inputCol", "sparse vectors", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "projected vectors", TypeConverters.toString)


def _sparse(df: DataFrame, column: str) -> DataFrame:
    """(at, value) arrays of the filled places of a vector column."""
    places = F.transform(vector_to_array(column), lambda v, i: F.struct(i.alias("at"), v.alias("value")))
    filled = F.filter(places, lambda p: p["value"] != 0)
    return df.select(filled["at"].alias("at"), filled["value"].alias("value"))


class TextPca(Estimator, _TextParams):
    """Principal components of wide sparse vectors, by block power iteration.

    A round sends a block of ``k`` and some more directions to all tasks and gets
    back, summed by place, what the centred rows make of it; the means are taken off
    as a rank-one term, so rows stay sparse and no square matrix is built. The driver
    holds that block: as many rows as there are terms.
    """

    def __init__(self, k: int, inputCol: str, outputCol: str, seed: int = 3):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)
        self.k, self.seed = k, seed

    def _fit(self, df: DataFrame) -> TextPcaModel:
        rows = _sparse(df, self.getOrDefault(self.inputCol)).persist()
        width = df.select(F.size(vector_to_array(self.getOrDefault(self.inputCol)))).first()[0]
        count = rows.count()
        sums = rows.select(F.explode(F.arrays_zip("at", "value")).alias("p")).groupBy("p.at").agg(F.sum("p.value").alias("s"))
        mean = np.zeros(width)
        for r in sums.collect():
            mean[r["at"]] = r["s"] / count
        block = np.linalg.qr(np.random.default_rng(self.seed).normal(size=(width, min(width, self.k + SPARE))))[0]
        for _ in range(POWER_ROUNDS):
            block = np.linalg.qr(self._turned(rows, block, mean)[0])[0]
        _, inner = self._turned(rows, block, mean)
        values, vectors = np.linalg.eigh(inner / max(1, count - 1))
        order = np.argsort(-values)[: self.k]
        parts = block @ vectors[:, order]
        # a sign that does not depend on the start
        top = np.abs(parts).argmax(axis=0)
        parts = parts * np.where(parts[top, np.arange(parts.shape[1])] < 0, -1.0, 1.0)
        rows.unpersist()
        names = {p: self.getOrDefault(getattr(self, p)) for p in ("inputCol", "outputCol")}
        return TextPcaModel(parts, values[order], **names)

    @staticmethod
    def _turned(rows: DataFrame, block: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centred rows' transpose times their product with the block, and that product's square."""
        width = block.shape[1]
        shift = mean @ block
        sent = rows.sparkSession.sparkContext.broadcast(block)

        def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}
            total, square = np.zeros(width), np.zeros((width, width))
            for frame in frames:
                for at, value in zip(frame["at"], frame["value"], strict=True):
                    made = value @ sent.value[at] - shift if len(at) else -shift
                    total += made
                    square += np.outer(made, made)
                    for i, v in zip(at.tolist(), value.tolist(), strict=True):
                        sums[i] = sums.get(i, 0.0) + v * made
            keys = [*sums, -1, *range(-2, -2 - width, -1)]
            yield pd.DataFrame({"at": keys, "made": [*sums.values(), total, *square]})

        made = rows.mapInPandas(turn, "at int, made array<double>")
        summed = made.select("at", F.posexplode("made").alias("i", "v")).groupBy("at", "i").agg(F.sum("v").alias("v"))
        out, total, inner = np.zeros_like(block), np.zeros(width), np.zeros((width, width))
        for at, i, v in summed.collect():
            if at >= 0:
                out[at, i] = v
            elif at == -1:
                total[i] = v
            else:
                inner[-2 - at, i] = v
        return out - np.outer(mean, total), inner


class _PartsWriter(DefaultParamsWriter):
    def saveImpl(self, path):
        model = self.instance
        rows = [(i, r.tolist()) for i, r in enumerate(np.vstack([model.parts, model.variance]))]
        self.sparkSession.createDataFrame(rows, "at int, part array<double>").write.parquet(f"{path}/parts")
        super().saveImpl(path)


class _PartsReader(DefaultParamsReader):
    def load(self, path):
        model = super().load(path)
        rows = self.sparkSession.read.parquet(f"{path}/parts").orderBy("at").collect()
        both = np.array([r["part"] for r in rows])
        model.parts, model.variance = both[:-1], both[-1]
        return model


class TextPcaModel(Model, _TextParams, DefaultParamsReadable, DefaultParamsWritable):
    """Projects vectors onto the components; rows are not centred, so the means shift all alike."""

    def __init__(self, parts: np.ndarray | None = None, variance: np.ndarray | None = None, **names):
        super().__init__()
        self.parts, self.variance = parts, variance
        self._set(**names)

    def write(self):
        return _PartsWriter(self)

    @classmethod
    def read(cls):
        return _PartsReader(cls)

    def _transform(self, df: DataFrame) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(self.parts)

        @F.pandas_udf("array<double>")
        def project(vectors: pd.Series) -> pd.Series:
            return pd.Series([v @ sent.value for v in vectors])

        made = project(vector_to_array(self.getOrDefault(self.inputCol)))
        return df.withColumn(self.getOrDefault(self.outputCol), array_to_vector(made))


def prepare(profiles: DataFrame) -> DataFrame:
    """Profile rows with normalised texts and every number as a double."""
    numbers = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in [*MOMENTS, *SHAPE]}
    flags = {c: F.col(c).cast("double") for c in FLAGS}
    digits = digit_columns()
    with_digits = profiles.select("*", *[d.cast("double") for d in digits]).withColumn(
        "comma_include", F.col("comma_include").cast("double")
    )
    return with_digits.withColumns({
        **numbers,
        **flags,
        "all_numeric": F.forall("samples", lambda s: is_number(s)).cast("double"),
        "name_text": normalize_text(F.col("column"), default="column"),
        "cell_1": normalize_text(F.get("samples", F.lit(0))),
        "cell_2": normalize_text(F.get("samples", F.lit(1))),
    })


def _tokens(source: str, out: str) -> RegexTokenizer:
    return RegexTokenizer(inputCol=source, outputCol=out, pattern=r"\w\w+", gaps=False)


def _shared_cells(prepared: DataFrame) -> list[str]:
    """Cell vocabulary fitted on the first and second sample together."""
    both = prepared.select(F.col("cell_1").alias("cell")).union(prepared.select("cell_2"))
    fitted = CountVectorizer(inputCol="t", outputCol="v", vocabSize=ALL_TERMS).fit(
        _tokens("cell", "t").transform(both)
    )
    return fitted.vocabulary


def feature_stages(prepared: DataFrame, stage: int, k: int = TEXT_DIMENSIONS, tfidf: bool = False) -> PipelineModel:
    """Fitted feature pipeline of a stage; its output column is ``features``.

    ``tfidf`` weighs the text vectors by inverse document frequency.

    Stage 1 reduces the text vectors and adds counts, moments and flags. Stage 2
    keeps the text vectors and adds sample shape and digit counts instead.
    """
    vocabulary = _shared_cells(prepared) or ["nothing"]
    stages = [_tokens("name_text", "name_tokens"), CountVectorizer(inputCol="name_tokens", outputCol="name_vec", vocabSize=ALL_TERMS)]
    for i in (1, 2):
        stages.append(_tokens(f"cell_{i}", f"cell_tokens_{i}"))
        stages.append(CountVectorizerModel.from_vocabulary(vocabulary, f"cell_tokens_{i}", f"cell_vec_{i}"))
    counts = "text_counts" if tfidf else "text_vec"
    stages.append(VectorAssembler(inputCols=["name_vec", "cell_vec_1", "cell_vec_2"], outputCol=counts))
    if tfidf:
        stages.append(IDF(inputCol=counts, outputCol="text_vec"))
    text = "text_vec"
    if stage == 1:
        fitted = Pipeline(stages=stages).fit(prepared)
        dims = fitted.transform(prepared.limit(1)).select(F.size(vector_to_array("text_vec"))).first()[0]
        reduced = TextPca(k=min(k, dims), inputCol="text_vec", outputCol="text_pca")
        stages = [fitted, reduced]
        text, numbers = "text_pca", [*MOMENTS, *SHAPE, *FLAGS, "all_numeric"]
    else:
        numbers = [*SHAPE, *FLAGS, *DIGITS]
    stages.append(VectorAssembler(inputCols=[text, *numbers], outputCol="features"))
    return Pipeline(stages=stages).fit(prepared)


def _label(labels: dict[str, int]) -> Column:
    return F.try_element_at(
        F.create_map(*[F.lit(x) for k, v in labels.items() for x in (k, float(v))]), F.col("subcategory")
    )


class TypeFeatures(Estimator):
    """Estimator form of :func:`feature_stages` on raw profile rows."""

    def __init__(self, stage: int = 1, k: int = TEXT_DIMENSIONS):
        super().__init__()
        self.stage, self.k = stage, k

    def _fit(self, profiles: DataFrame) -> TypeFeaturesModel:
        return TypeFeaturesModel(feature_stages(prepare(profiles), self.stage, self.k))


class TypeFeaturesModel(Model):
    def __init__(self, stages: PipelineModel):
        super().__init__()
        self.stages = stages

    def _transform(self, profiles: DataFrame) -> DataFrame:
        return self.stages.transform(prepare(profiles))


class TypeClassifier(Estimator):
    """Fits both stages on profiles with a ``subcategory`` label column.

    ``learner`` is "forest" or "logistic"; ``tfidf`` weighs the text features.
    """

    def __init__(
        self, trees: int = 30, depth: int = 8, seed: int = 0, k: int = TEXT_DIMENSIONS, learner: str = "forest",
        tfidf: bool = False,
    ):
        super().__init__()
        self.trees, self.depth, self.seed, self.k = trees, depth, seed, k
        self.learner, self.tfidf = learner, tfidf

    def _stage(self, rows: DataFrame, stage: int, labels: dict[str, int]) -> PipelineModel:
        prepared = prepare(rows).withColumn("label", _label(labels)).filter(F.col("label").isNotNull())
        features = feature_stages(prepared, stage, self.k, self.tfidf)
        names = {"predictionCol": f"prediction_{stage}", "probabilityCol": f"probability_{stage}", "rawPredictionCol": f"raw_{stage}"}
        if self.learner == "logistic":
            learner = LogisticRegression(**names)
        else:
            learner = RandomForestClassifier(numTrees=self.trees, maxDepth=self.depth, seed=self.seed, **names)
        return PipelineModel([features, learner.fit(features.transform(prepared))])

    def _fit(self, profiles: DataFrame) -> TypeClassifierModel:
        rows = drop_degenerate(profiles)
        return TypeClassifierModel(
            self._stage(rows, 1, STAGE_ONE), self._stage(rows, 2, STAGE_TWO)
        )


class TypeClassifierModel(Model):
    """Adds ``type`` and the class probabilities of both stages to profile rows."""

    def __init__(self, first: PipelineModel, second: PipelineModel):
        super().__init__()
        self.first, self.second = first, second

    def _transform(self, profiles: DataFrame) -> DataFrame:
        scored = prepare(profiles)
        keep = list(scored.columns)
        for number, stage in ((1, self.first), (2, self.second)):
            out = stage.transform(scored.select(*keep))
            keep = [*keep, f"prediction_{number}", f"probability_{number}"]
            scored = out.select(*keep)
        names = F.create_map(*[F.lit(x) for k, v in STAGE_TWO_TYPES.items() for x in (float(k), v)])
        code = (
            F.when(F.col("prediction_1") == 2, F.try_element_at(names, F.col("prediction_2")))
            .when(F.col("prediction_1") == 3, DROP)
            .otherwise(F.col("prediction_1").cast("int"))
        )
        return scored.withColumn("type", code.cast("int"))

    def probabilities(self, profiles: DataFrame, table: str = "table") -> DataFrame:
        """Long form (table_id, column_id, class, probability) for candidates.

        A stage-2 class counts with its stage-2 probability, and only where the
        stage-1 class "needs the second stage" is itself more likely than chance.
        """
        scored = self.transform(profiles).select(
            F.col(table).alias("table_id"),
            F.col("pos").alias("column_id"),
            vector_to_array("probability_1").alias("p1"),
            vector_to_array("probability_2").alias("p2"),
        )
        first = scored.select(
            "table_id", "column_id", F.posexplode("p1").alias("stage_class", "probability"),
            (1.0 / F.size("p1")).alias("chance"), "p2",
        ).filter(F.col("probability") > F.col("chance"))
        direct = first.filter(F.col("stage_class") != 2).select(
            "table_id", "column_id",
            F.when(F.col("stage_class") == 3, DROP).otherwise(F.col("stage_class")).cast("int").alias("class"),
            "probability",
        )
        names = F.create_map(*[F.lit(x) for pair in STAGE_TWO_TYPES.items() for x in pair])
        second = (
            first.filter(F.col("stage_class") == 2)
            .select("table_id", "column_id", F.posexplode("p2").alias("c", "probability"), (1.0 / F.size("p2")).alias("chance"))
            .filter(F.col("probability") > F.col("chance"))
            .select("table_id", "column_id", F.try_element_at(names, F.col("c")).alias("class"), "probability")
        )
        return direct.unionByName(second)

    def save(self, path: str) -> None:
        self.first.write().overwrite().save(f"{path}/first")
        self.second.write().overwrite().save(f"{path}/second")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TypeClassifierModel:
        return cls(PipelineModel.load(f"{path}/first"), PipelineModel.load(f"{path}/second"))
