"""Semantic types of columns: rules over a profile, candidates, and their choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import parts
from tablewright.functions.cells import is_number
from tablewright.functions.samples import PLAIN_NUMBER, count_matching
from tablewright.operators.profile import (
    apply_override,
    category_size,
    column_samples,
    column_stats,
    count_sizes,
    mixed_columns,
    sample_shape,
    value_counts,
)
from tablewright.operators.transforms import detect_splits, maybe_split
from tablewright.session import durable

# The semantic types and their display names.
NUMERIC, CATEGORICAL, DATETIME, SENTENCE, URL, EMBEDDED = 0, 1, 2, 3, 4, 5
LIST, DROP, UNIT, SIGN, RANGE, FORMATTED_ID = 6, 7, 8, 9, 10, 11
TYPE_NAMES = {
    0: "Numerical",
    1: "Categorical",
    2: "Datetime",
    3: "Sentence",
    4: "URL",
    5: "Embedded numbers",
    6: "List",
    7: "ID",
    8: "Numbers with Unit",
    9: "Numbers with Sign",
    10: "Range of Numbers",
    11: "Formatted ID",
}

# Class numbers of the two stages.
STAGE_ONE = {
    "numeric": 0, "categorical": 1, "datetime": 2, "sentence": 2, "url": 2, "embed": 2, "list": 2,
    "unit": 2, "range": 2, "sign": 2, "not-generalizable": 3, "formatted-id": 2,
}
STAGE_TWO = {
    "datetime": 0, "sentence": 1, "url": 2, "list": 3, "embed": 4, "unit": 5, "range": 6, "sign": 7,
    "formatted-id": 8,
}
STAGE_TWO_TYPES = {0: 2, 1: 3, 2: 4, 3: 6, 4: 5, 5: 8, 6: 10, 7: 9, 8: 11}
LABELS = {
    0: "numeric", 1: "categorical", 2: "datetime", 3: "sentence", 4: "url", 5: "embed", 6: "list",
    7: "not-generalizable", 8: "unit", 9: "sign", 10: "range", 11: "formatted-id",
}
SPECIAL_TYPES = (4, 5, 6, 8, 9, 10, 11)
TOP_CANDIDATES = 50


def type_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    return F.try_element_at(names, code)


def normalize_text(col: Column, digits: bool = True, default: str = "nothing") -> Column:
    """Lower-case text with a default for null and digit runs as one token."""
    text = F.lower(F.coalesce(col.cast("string"), F.lit(default)))
    return F.regexp_replace(text, r"\d+", "num") if digits else text


def drop_degenerate(profiles: DataFrame, label: str = "subcategory") -> DataFrame:
    """Drop rows labelled numeric whose moments are all zero."""
    flat = (
        (F.col(label) == "numeric")
        & (F.col("mean") == 0)
        & (F.col("std_dev") == 0)
        & (F.col("min_val") == 0)
        & (F.col("max_val") == 0)
    )
    return profiles.filter(~F.coalesce(flat, F.lit(False)))


def single_value_override(code: Column, distinct: Column) -> Column:
    """A column with exactly one distinct value is categorical."""
    return F.when(distinct == 1, F.lit(CATEGORICAL)).otherwise(code)


# --- rules ------------------------------------------------------------------

UNIT_NAMES = tuple(parts.UNIT_FACTORS)


def _has_unit(s: Column) -> Column:
    unit = F.trim(F.regexp_replace(s, r"[0-9.]+", ""))
    return s.rlike(r"\d") & unit.isin(*UNIT_NAMES)


def _has_sign(s: Column) -> Column:
    sign = F.lower(F.trim(F.regexp_replace(s, parts.NUMBER_RUN, "")))
    return s.rlike(r"\d") & sign.isin(*parts.BELOW_WORDS, *parts.ABOVE_WORDS)


def _is_range(s: Column) -> Column:
    return s.rlike(r"^\s*-?\d*\.?\d+\s*(-|:|to|~|～|から)\s*-?\d*\.?\d+\s*$")


def _one_number(s: Column) -> Column:
    return (F.regexp_count(s, F.lit(parts.NUMBER_RUN)) == 1) & ~is_number(s) & (F.size(F.split(s, " ")) <= 3)


def rule_type(split_parts: Column) -> Column:
    """Type code of a profile row; the first rule that holds decides."""
    name, distinct, total = F.col("column"), F.col("num_of_dist_val"), F.col("total_vals")
    few = F.col("category_size").isin("binary", "small")
    key_name = F.lower(name).rlike("(key|id)$")
    most = lambda test: count_matching("samples", test) > 2
    return (
        F.when(distinct <= 1, CATEGORICAL)
        .when(
            (F.col("dtype") == "integer") & (distinct == total) & key_name,
            DROP,
        )
        .when(F.col("is_numeric_dtype") & few, CATEGORICAL)
        .when(F.col("is_numeric_dtype"), NUMERIC)
        .when(F.col("dtype") == "datetime", DATETIME)
        .when(F.col("has_url"), URL)
        .when(F.col("has_date"), DATETIME)
        .when(most(lambda s: s.rlike(r"^\s*\[.*\]\s*$")) | F.col("is_list"), LIST)
        .when(most(_is_range), RANGE)
        .when(most(_has_sign), SIGN)
        .when(most(_has_unit), UNIT)
        .when((split_parts > 1) & (F.col("mean_word_count") <= SHORT_WORDS), FORMATTED_ID)
        .when(most(_one_number), EMBEDDED)
        .when(F.col("is_long_sentence"), SENTENCE)
        .when(most(lambda s: s.rlike(PLAIN_NUMBER)), NUMERIC)
        .when(F.col("category_size") != "none", CATEGORICAL)
        .when(distinct == total, DROP)
        .otherwise(SENTENCE)
    )


SHORT_WORDS = 10


def type_profile(df: DataFrame, key: str | Sequence[str] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Profile with everything the rules read: shape, category size, splits, text cells.

    The first rows by key settle most samples. Of the value counts only their sizes
    are kept, which are few; no distinct value is written. The shapes tell which text
    columns are short enough to be formatted IDs; only those are scanned for
    separators, unless their first rows show that there are none.
    """
    names = df.columns if columns is None else list(columns)
    counts = durable(value_counts(df, None, names)) if key is None else None
    sizes = durable(count_sizes(value_counts(df, None, names) if counts is None else counts))
    samples = column_samples(df, key, columns=names, counts=counts)
    if key is not None:
        samples = apply_override(samples, mixed_columns(df, key, names))
    shaped = durable(sample_shape(samples))
    splittable = (
        (F.col("dtype") == "string")
        & ~F.col("has_url")
        & ~F.col("has_date")
        & (F.col("mean_word_count") <= SHORT_WORDS)
    )
    short = [r["column"] for r in shaped.filter(splittable).select("column").collect()]
    out = column_stats(df, names, sizes=sizes)
    out = out.join(F.broadcast(shaped.drop("column", "dtype", "is_numeric_dtype")), "pos")
    out = out.join(F.broadcast(category_size(df, names, sizes=sizes).drop("column")), "pos")
    open_columns = maybe_split(df, short)
    if not open_columns:
        return out.withColumn("parts", F.lit(1))
    # One row per text column.
    splits = detect_splits(df, open_columns, value_counts(df, None, open_columns)).select("column", "parts")
    return out.join(F.broadcast(splits), "column", "left").withColumn(
        "parts", F.coalesce("parts", F.lit(1))
    )


def infer_types(
    df: DataFrame,
    key: str | Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
    model=None,
) -> DataFrame:
    """(pos, column, type, type_name), by rules or by a fitted type classifier."""
    profiles = type_profile(df, key, columns)
    if model is None:
        typed = profiles.withColumn("type", rule_type(F.col("parts")).cast("int"))
    else:
        typed = model.transform(profiles)
    typed = typed.withColumn(
        "type", single_value_override(F.col("type"), F.col("num_of_dist_val")).cast("int")
    )
    return typed.select("pos", "column", "type", type_name(F.col("type")).alias("type_name"))


def types_of(df: DataFrame, key=None, columns=None, model=None) -> dict[str, int]:
    """Types by column name; one small row per column reaches the driver."""
    rows = infer_types(df, key, columns, model).collect()
    return {r["column"]: r["type"] for r in rows}


# --- candidates -------------------------------------------------------------


def candidate_classes(probabilities: DataFrame, filtered: bool = False) -> DataFrame:
    """Per (table, column): the classes more likely than chance, with probabilities.

    ``filtered`` says the rows already hold such classes only.
    """
    by_column = probabilities.groupBy("table_id", "column_id").agg(
        F.count(F.lit(1)).alias("k"),
        F.sort_array(F.collect_list(F.struct("class", "probability"))).alias("classes"),
    )
    chance = F.lit(0.0) if filtered else 1.0 / F.col("k")
    kept = F.filter("classes", lambda c: c["probability"] > chance)
    return by_column.select("table_id", "column_id", kept.alias("classes"))


def type_candidates(
    probabilities: DataFrame, top_n: int = TOP_CANDIDATES, filtered: bool = False, fallback: DataFrame | None = None
) -> DataFrame:
    """Best combinations of column types per table: (table_id, rank, types, score).

    ``fallback`` (table_id, column_id, class) lists all columns with their likeliest
    class, which a column takes, at no score, when no class is above chance: types
    stay in the places of their columns.

    The score is a sum over columns, so keeping the best ``top_n`` partial sums
    after each column gives the exact top ``top_n`` without the full product. One
    table's columns, not its rows, are gathered, so a group is a schema wide.
    """
    classes = candidate_classes(probabilities, filtered)
    if fallback is not None:
        likeliest = F.array(F.struct(F.col("_class").alias("class"), F.lit(0.0).alias("probability")))
        every = fallback.select("table_id", "column_id", F.col("class").alias("_class"))
        classes = every.join(classes, ["table_id", "column_id"], "left").select(
            "table_id", "column_id",
            F.when(F.size("classes") > 0, F.col("classes")).otherwise(likeliest).alias("classes"),
        )
    per_table = classes.groupBy("table_id").agg(
        F.sort_array(F.collect_list(F.struct("column_id", "classes"))).alias("columns")
    )
    start = F.array(
        F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<int>").alias("types"))
    )

    def extend(best: Column, column: Column) -> Column:
        longer = F.flatten(
            F.transform(
                best,
                lambda b: F.transform(
                    column["classes"],
                    lambda c: F.struct(
                        (b["cost"] - c["probability"]).alias("cost"),
                        F.concat(b["types"], F.array(c["class"])).alias("types"),
                    ),
                ),
            )
        )
        return F.slice(F.sort_array(longer), 1, top_n)

    best = F.aggregate("columns", start, extend)
    return per_table.select("table_id", F.posexplode(best).alias("_i", "b")).select(
        "table_id",
        (F.col("_i") + 1).alias("rank"),
        F.col("b.types").alias("types"),
        (-F.col("b.cost")).alias("score"),
    )


def best_candidate(scores: DataFrame, by: Sequence[str] = ("table_id",)) -> DataFrame:
    """Highest scored candidate; among ties the first with a special type, else the first."""
    special = F.exists("types", lambda t: t.isin(*SPECIAL_TYPES))
    best = F.max(
        F.struct(
            F.col("score").alias("score"),
            special.alias("special"),
            (-F.col("rank")).alias("first"),
            F.col("types").alias("types"),
        )
    )
    return scores.groupBy(*by).agg(best.alias("b")).select(
        *by, (-F.col("b.first")).alias("rank"), F.col("b.types").alias("types"), F.col("b.score").alias("score")
    )


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Confusion counts with the overall accuracy on every row."""
    cells = df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))
    overall = cells.agg(
        (F.sum(F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy")
    )
    return cells.withColumn("accuracy", overall.scalar())
