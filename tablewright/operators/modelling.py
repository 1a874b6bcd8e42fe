"""Enrichment rounds, model pipelines and their scores."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import infer as I
from tablewright.operators import transforms as X
from tablewright.operators.boosting import BoostedTrees
from tablewright.operators.sampling import capped_sample, hash_split
from tablewright.session import durable, written

# Boosted-tree budget.
ROUNDS, DEPTH, RATE, LEAVES = 30, 3, 0.25, 7
MAX_ROUNDS = 3
# Rows per class that candidates are fitted and checked on.
TRAIN_ROWS, VALIDATION_ROWS = 200, 80
#: Errors that a candidate's own columns can cause.
CANDIDATE_FAULTS = (AnalysisException, IllegalArgumentException, ValueError, ArithmeticError)
READY = (I.NUMERIC, I.CATEGORICAL, I.SENTENCE)

TRANSFORMS = {
    I.DATETIME: X.DateParts,
    I.URL: X.UrlParts,
    I.EMBEDDED: X.EmbeddedNumber,
    I.LIST: X.ListColumns,
    I.DROP: X.DropColumns,
    I.UNIT: X.UnitNumber,
    I.SIGN: X.SignNumber,
    I.RANGE: X.RangeNumber,
    I.FORMATTED_ID: X.FormattedId,
}
KEPT_IN_PLACE = (I.EMBEDDED, I.UNIT, I.SIGN)
TEXT_SUFFIXES = ("_as_sentence", "_Domain", "_Path", "_LastPath", "_unchanged")


def enrich(
    df: DataFrame,
    types: dict[str, int],
    max_rounds: int = MAX_ROUNDS,
    key: str | Sequence[str] | None = None,
    model=None,
) -> tuple[DataFrame, dict[str, int], PipelineModel]:
    """Apply the transform of every column that is not ready for a model yet.

    New columns are typed by ``model``, a fitted type classifier, or by the rules.

    Each round fits one transform per type, applies them as projections and types
    all new columns together. Row keys stay out of ``types`` and pass through. The
    new columns are written for that, as a profile reads them several times.
    """
    keys = [] if key is None else [key] if isinstance(key, str) else list(key)
    types = dict(types)
    stages = []
    for _ in range(max_rounds):
        todo: dict[int, list[str]] = {}
        for column, code in types.items():
            if code not in READY:
                todo.setdefault(code, []).append(column)
        if not todo:
            break
        before = set(df.columns)
        for code, columns in sorted(todo.items()):
            stage = TRANSFORMS[code](columns)
            fitted = stage.fit(df) if hasattr(stage, "fit") else stage
            df = fitted.transform(df)
            stages.append(fitted)
        types = {
            c: (I.NUMERIC if code in KEPT_IN_PLACE else code)
            for c, code in types.items()
            if c in df.columns
        }
        fresh = [c for c in df.columns if c not in before]
        if fresh:
            for column, code in I.types_of(_made_once(df, [*keys, *fresh]), key, fresh, model).items():
                forced = column.endswith(TEXT_SUFFIXES) and code != I.DROP
                types[column] = I.SENTENCE if forced or code == I.FORMATTED_ID else code
    return df, types, PipelineModel(stages)


def _made_once(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as a written table; names made of cells stay out of its files."""
    names = list(dict.fromkeys(columns))
    return written(df.select(*map(X.q, names)).toDF(*[f"c{i}" for i in range(len(names))]), "enriched").toDF(*names)


def build_pipeline(
    types: dict[str, int], targets: Sequence[str], task: str, learner: str = "gbt", seed: int = 0
) -> list[Pipeline]:
    """One pipeline per target: scale, encode, weigh text, assemble, learn.

    ``learner`` is "gbt" (Spark's own trees, one model a class), "boosted" (one model for
    all classes, best leaf first) or "rf".
    """
    budget = {"rounds": ROUNDS, "depth": DEPTH, "rate": RATE, "leaves": LEAVES}
    inputs = {c: t for c, t in types.items() if c not in targets}
    numeric = [c for c, t in inputs.items() if t == I.NUMERIC]
    categories = [c for c, t in inputs.items() if t == I.CATEGORICAL]
    texts = [c for c, t in inputs.items() if t == I.SENTENCE]
    shared = [
        X.ModeImpute([*numeric, *categories, *texts]),
        X.Standardize(numeric),
        X.OrdinalEncode(categories),
        X.TextTfIdf(texts),
        VectorAssembler(
            inputCols=[*numeric, *categories, *[f"{c}_tfidf" for c in texts]],
            outputCol="features",
            handleInvalid="keep",
        ),
    ]
    shared = [s for s in shared if not isinstance(s, X._Fit) or s.getColumns()]
    pipelines = []
    for target in targets:
        column = {"labelCol": target, "predictionCol": f"{target}_predicted", "seed": seed}
        if learner == "boosted":
            del column["seed"]  # nothing is drawn
        if task == "regression":
            last = (
                BoostedTrees(loss="squared", **column, **budget)
                if learner == "boosted"
                else GBTRegressor(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=RATE, **column)
                if learner == "gbt"
                else RandomForestRegressor(**column)
            )
            pipelines.append(Pipeline(stages=[*shared, last]))
            continue
        column["labelCol"] = f"{target}_index"
        index = StringIndexer(inputCol=target, outputCol=f"{target}_index", handleInvalid="keep")
        if learner == "boosted":
            last = BoostedTrees(probabilityCol=f"{target}_probability", **column, **budget)
        elif learner == "gbt":  # Spark's boosted trees tell two classes apart, so one model per class
            trees = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=RATE, seed=seed)
            last = OneVsRest(
                classifier=trees, labelCol=column["labelCol"], predictionCol=column["predictionCol"]
            )
        else:
            last = RandomForestClassifier(**column)
        pipelines.append(Pipeline(stages=[*shared, index, last]))
    return pipelines


def score(df: DataFrame, targets: Sequence[str], predictions: Sequence[str], task: str) -> DataFrame:
    """Accuracy (all targets right) or mean R² of the targets, one row."""
    if task == "classification":
        right = F.lit(True)
        for t, p in zip(targets, predictions):
            right = right & F.col(t).eqNullSafe(F.col(p))
        return df.agg(F.avg(right.cast("double")).alias("score"))
    ratios = []
    for t, p in zip(targets, predictions):
        miss = F.col(t) - F.col(p)
        spread = F.var_pop(t) * F.count(t)
        ratios.append(1.0 - F.try_divide(F.sum(miss * miss), spread))
    total = ratios[0]
    for r in ratios[1:]:
        total = total + r
    return df.agg((total / F.lit(float(len(ratios)))).alias("score"))


def score_candidates(
    train: DataFrame,
    validation: DataFrame,
    candidates: Sequence[dict[str, int]],
    targets: Sequence[str],
    task: str,
    learner: str = "gbt",
    key: str | Sequence[str] | None = None,
    model=None,
    at_once: int = 4,
    failed: list[tuple[int, list[int], str]] | None = None,
) -> list[tuple[int, list[int], float]]:
    """Fit every candidate on the capped sample and score it on the validation part.

    Returns (rank, types, score) rows for :func:`tablewright.operators.infer.best_candidate`,
    and adds to ``failed`` (rank, types, reason) of the candidates that have no score:
    those whose columns cannot be fitted (``CANDIDATE_FAULTS``) or give no number. Any other
    error, a lost executor among them, ends the search. ``at_once`` candidates
    are worked on side by side.
    """
    scored = []
    failed = [] if failed is None else failed

    def one(rank: int, types: dict[str, int]):
        try:
            inputs = {c: t for c, t in types.items() if c not in targets}
            enriched, final, chain = enrich(train, inputs, key=key, model=model)
            checked = chain.transform(validation)
            predicted, names = checked, []
            for target, pipeline in zip(targets, build_pipeline(final, targets, task, learner)):
                fitted = pipeline.fit(enriched)
                predicted = fitted.transform(predicted).drop("features")
                names.append(target)
            labels = targets if task == "regression" else [f"{t}_index" for t in targets]
            value = score(predicted, labels, [f"{t}_predicted" for t in targets], task).first()["score"]
        except CANDIDATE_FAULTS as error:
            return rank, list(types.values()), None, f"{type(error).__name__}: {error}"[:500]
        return rank, list(types.values()), value, "no score"

    with ThreadPoolExecutor(at_once) as pool:
        for rank, types, value, reason in pool.map(lambda x: one(*x), enumerate(candidates, start=1)):
            if value is None or value != value:
                failed.append((rank, types, reason))
            else:
                scored.append((rank, types, float(value)))
    return scored


def search_types(
    df: DataFrame,
    key: str | Sequence[str],
    targets: Sequence[str],
    task: str,
    model,
    top_n: int = I.TOP_CANDIDATES,
    learner: str = "gbt",
) -> dict[str, int]:
    """Column types that let a model predict the targets best.

    Candidates come from a fitted type classifier on the training part. Each is
    scored on capped samples, which are written once for all candidates. Without
    a candidate that can be scored, the plain prediction is returned.
    """
    spark = df.sparkSession
    keys = [key] if isinstance(key, str) else list(key)
    inputs = [c for c in df.columns if c not in (*keys, *targets)]
    parts = hash_split(df, key)
    train = parts.filter(F.col("split") == "train").drop("split")
    validation = parts.filter(F.col("split") == "validation").drop("split")
    profiles = durable(I.type_profile(train, key, inputs).withColumn("table", F.lit("input")))
    # without a classifier that predicts, the rules say what a column is when no class is above chance
    typed = model.transform(profiles) if hasattr(model, "transform") else profiles.withColumn("type", I.rule_type(F.col("parts")).cast("int"))
    likeliest = typed.select(F.col("table").alias("table_id"), F.col("pos").alias("column_id"), F.col("type").alias("class"))
    found = I.type_candidates(model.probabilities(profiles), top_n, filtered=True, fallback=likeliest)
    candidates = [dict(zip(inputs, r["types"])) for r in found.orderBy("rank").collect()]
    failed: list[tuple[int, list[int], str]] = []
    scored = score_candidates(
        durable(capped_sample(train, targets[0], TRAIN_ROWS, key, task)),
        durable(capped_sample(validation, targets[0], VALIDATION_ROWS, key, task)),
        candidates,
        targets,
        task,
        learner,
        key,
        model if hasattr(model, "transform") else None,
        failed=failed,
    )
    for rank, types, reason in failed:
        warnings.warn(f"candidate {rank} has no score: {reason}", stacklevel=2)
    if not scored:
        return {r["column"]: r["type"] for r in typed.select("column", "type").collect()}
    rows = spark.createDataFrame(
        [(0, *s) for s in scored], "table_id int, rank int, types array<int>, score double"
    )
    return dict(zip(inputs, I.best_candidate(rows).first()["types"]))
