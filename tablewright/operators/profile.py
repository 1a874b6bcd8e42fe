"""Column profiling: one aggregate pass plus one pass over (column, value) pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import samples as S
from tablewright.functions.cells import (
    cell_text,
    clean,
    is_number,
    is_numeric_field,
)
from tablewright.operators.ranking import small_or_shuffled, top_per_group
from tablewright.session import durable

SAMPLES = 5
LONG_TEXT = 64
#: First rows of a table that are looked at before all of them.
FIRST_ROWS = 256
DIGEST_MARK = "\u0001"


def _columns(df: DataFrame, columns: Sequence[str] | None) -> list[T.StructField]:
    wanted = df.columns if columns is None else list(columns)
    return [df.schema[c] for c in wanted]


def _order(key: str | Sequence[str]) -> Column:
    names = [key] if isinstance(key, str) else list(key)
    return F.col(names[0]) if len(names) == 1 else F.struct(*names)


def value_type_name(field: T.StructField) -> str:
    """Name of a column's kind of value, from its schema type."""
    kind = field.dataType
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "floating"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "string"


def columns_frame(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: position, name, value type, numeric or not."""
    rows = [
        F.struct(
            F.lit(i).alias("pos"),
            F.lit(f.name).alias("column"),
            F.lit(value_type_name(f)).alias("dtype"),
            F.lit(is_numeric_field(f)).alias("is_numeric_dtype"),
        )
        for i, f in enumerate(_columns(df, columns))
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def _token(value: Column) -> Column:
    """A short stand-in for a value: long texts travel as their start and a digest, not in full."""
    return F.when(F.length(value) <= LONG_TEXT, value).otherwise(
        F.concat(F.substring(value, 1, LONG_TEXT), F.lit(DIGEST_MARK), F.sha2(value, 256))
    )


def is_long(token: Column) -> Column:
    return (F.length(token) == LONG_TEXT + 65) & (F.substring(token, LONG_TEXT + 1, 1) == DIGEST_MARK)


def _stored_as(field: T.StructField) -> str:
    """How a value travels through the count: whole number, time, fraction or text."""
    kind = field.dataType
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return "boolean" if isinstance(kind, T.BooleanType) else "whole"
    if isinstance(kind, T.TimestampType):
        return "time"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, T.DoubleType):
        return "fraction"
    return "text"


def _typed_cell(field: T.StructField) -> tuple[Column, Column, Column]:
    """(whole, fraction, text) fields of a cell; only one of them is ever filled."""
    stored, value = _stored_as(field), clean(field)
    whole, fraction, text = F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if stored == "fraction":
        fraction = value
    elif stored == "time":
        whole = F.unix_micros(value)
    elif stored == "date":
        whole = F.unix_date(value).cast("bigint")
    elif stored in ("whole", "boolean"):
        whole = value.cast("bigint")
    else:
        text = _token(cell_text(field))
    return whole, fraction, text


def _token_of(fields: Sequence[T.StructField]) -> Column:
    """Text form of a counted value, made once per distinct value."""
    stored = [_stored_as(f) for f in fields]

    def at(kind: str) -> Column:
        return F.col("pos").isin([i for i, s in enumerate(stored) if s == kind])

    whole = F.col("whole")
    forms = {
        "whole": whole.cast("string"),
        "boolean": whole.cast("boolean").cast("string"),
        "time": F.timestamp_micros(whole).cast("string"),
        "date": F.date_from_unix_date(whole.cast("int")).cast("string"),
        "fraction": F.col("fraction").cast("string"),
    }
    token = F.col("text")
    for kind, form in forms.items():
        if kind in stored:
            token = F.when(at(kind), form).otherwise(token)
    return token


def value_counts(
    df: DataFrame, key: str | Sequence[str] | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """(pos, token, n, first): rows per distinct value and the key of its first row.

    Values are counted in their own type and turned into text afterwards, so the
    scan formats nothing and the shuffle carries numbers, not digits.
    """
    fields = _columns(df, columns)
    cells = F.array(*[
        F.struct(F.lit(i).alias("pos"), *[
            v.alias(n) for v, n in zip(_typed_cell(f), ("whole", "fraction", "text"))
        ])
        for i, f in enumerate(fields)
    ])
    head = [] if key is None else [_order(key).alias("ord")]
    parts = ["whole", "fraction", "text"]
    filled = F.col("whole").isNotNull() | F.col("fraction").isNotNull() | F.col("text").isNotNull()
    grouped = df.select(*head, F.inline(cells)).filter(filled).groupBy("pos", *parts)
    aggs = [F.count(F.lit(1)).alias("n")]
    if key is not None:
        aggs.append(F.min("ord").alias("first"))
    counts = grouped.agg(*aggs).withColumn("token", _token_of(fields)).drop(*parts)
    if key is None:
        counts = counts.withColumn("first", F.col("token"))
    # Every consumer reads all columns, so one shuffle of the values serves them all.
    return counts.filter(F.col("n") > 0)


def top_values(
    df: DataFrame, counts: DataFrame, before: Sequence[Column], k: int, columns: Sequence[str] | None = None,
    after: Sequence[Column] = (),
) -> DataFrame:
    """First ``k`` values of each column by ``before``, then by full value: counts with ``rank`` and ``value``.

    Long texts that agree in their start tie at first; all that might be among the
    first ``k`` are looked up and then ordered by their whole text.
    """
    start = F.when(is_long(F.col("token")), F.substring("token", 1, LONG_TEXT)).otherwise(F.col("token"))
    window = Window.partitionBy("pos").orderBy(*before, start)
    near = counts.withColumn("_near", F.rank().over(window)).filter(F.col("_near") <= k).drop("_near")
    full = resolve_tokens(df, near, columns)
    return top_per_group(full, ["pos"], [*before, F.col("value"), *after], k)


def resolve_tokens(df: DataFrame, tokens: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Add the full ``value`` of each token.

    A second scan of the text columns picks up the texts sent as digests; it joins
    by digest, and one text of each is kept before the shuffle.
    """
    fields = _columns(df, columns)
    texts = [(i, f) for i, f in enumerate(fields) if isinstance(f.dataType, T.StringType)
             or isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    if not texts:
        return tokens.withColumn("value", F.col("token"))
    cells = F.array(
        *[F.struct(F.lit(i).alias("pos"), cell_text(f).alias("value")) for i, f in texts]
    )
    long_cells = (
        df.select(F.inline(cells))
        .filter(F.length("value") > LONG_TEXT)
        .withColumn("token", _token(F.col("value")))
    )
    wanted = tokens.filter(is_long(F.col("token"))).select("pos", "token").distinct()
    found = (
        long_cells.join(small_or_shuffled(wanted), ["pos", "token"])
        .groupBy("pos", "token")
        .agg(F.min("value").alias("_full"))
    )
    return (
        tokens.join(found, ["pos", "token"], "left")
        .withColumn("value", F.coalesce("_full", "token"))
        .drop("_full")
    )


def count_sizes(counts: DataFrame) -> DataFrame:
    """(pos, n, values): how many distinct values of a column are met ``n`` times.

    A column of ``r`` rows has fewer than the root of ``2 r`` such sizes, so this is
    small however many values there are.
    """
    return counts.groupBy("pos", "n").agg(F.count(F.lit(1)).alias("values"))


def distinct_counts(counts: DataFrame) -> DataFrame:
    """Distinct and non-missing values per column, from value counts."""
    return counts.groupBy("pos").agg(
        F.count(F.lit(1)).alias("num_of_dist_val"),
        F.sum("n").alias("non_null"),
        F.max("first").alias("_last_first"),
    ).drop("_last_first")


def _moments(df: DataFrame, fields: Sequence[T.StructField], approx: bool) -> DataFrame:
    """One pass over the table: counts and numeric moments of every column."""
    aggs = [F.count(F.lit(1)).alias("total_vals")]
    for i, f in enumerate(fields):
        column = clean(f)
        aggs.append(F.count(column).alias(f"c{i}"))
        if approx:
            aggs.append(F.approx_count_distinct(column).alias(f"d{i}"))
        if is_numeric_field(f):
            number = column.cast("int") if isinstance(f.dataType, T.BooleanType) else column
            number = number.cast("double")
            aggs += [
                F.avg(number).alias(f"m{i}"),
                F.stddev_pop(number).alias(f"s{i}"),
                F.min(number).alias(f"lo{i}"),
                F.max(number).alias(f"hi{i}"),
            ]
    zero = F.lit(0.0)
    rows = []
    for i, f in enumerate(fields):
        numeric = is_numeric_field(f)
        rows.append(
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(f.name).alias("column"),
                F.lit(value_type_name(f)).alias("dtype"),
                F.lit(numeric).alias("is_numeric_dtype"),
                F.col("total_vals"),
                (F.col("total_vals") - F.col(f"c{i}")).alias("num_nans"),
                *([F.col(f"d{i}").alias("num_of_dist_val")] if approx else []),
                *[
                    (F.coalesce(F.col(f"{p}{i}"), zero) if numeric else zero).alias(n)
                    for p, n in (("m", "mean"), ("s", "std_dev"), ("lo", "min_val"), ("hi", "max_val"))
                ],
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def with_ratios(stats: DataFrame) -> DataFrame:
    total = F.col("total_vals").cast("double")
    return stats.withColumns(
        {
            "pct_dist_val": F.try_divide(F.col("num_of_dist_val") * 100.0, total),
            "pct_nans": F.try_divide(F.col("num_nans") * 100.0, total),
        }
    )


def column_stats(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    approx: bool = False,
    counts: DataFrame | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Counts, moments and ratios, one row per column.

    ``approx`` replaces exact distinct counts by a sketch in the same single pass.
    ``sizes`` may give the count sizes instead of ``counts``.
    """
    fields = _columns(df, columns)
    moments = _moments(df, fields, approx)
    if not approx:
        if sizes is not None:
            distinct = sizes.groupBy("pos").agg(F.sum("values").alias("num_of_dist_val"))
        else:
            counts = value_counts(df, None, columns) if counts is None else counts
            distinct = distinct_counts(counts).drop("non_null")
        # At most one row per column of the schema.
        moments = moments.join(F.broadcast(distinct), "pos", "left")
        moments = moments.withColumn("num_of_dist_val", F.coalesce("num_of_dist_val", F.lit(0)))
    return with_ratios(moments)


def _first_values(
    df: DataFrame, key: str | Sequence[str], n: int, columns: Sequence[str] | None, order: Sequence[Column]
) -> DataFrame:
    """(pos, rank, value): the first ``n`` distinct values of each column in row order.

    The first rows by key decide for columns that have ``n`` values before the last of
    these rows; only the other columns, mostly of few values, are counted in full.
    """
    names = [f.name for f in _columns(df, columns)]
    keys = [key] if isinstance(key, str) else list(key)
    wanted = df.select(*[F.col(c) for c in dict.fromkeys([*keys, *names])])
    head = durable(wanted.orderBy(_order(key).asc_nulls_last()).limit(FIRST_ROWS))
    counts = durable(value_counts(head, key, names))
    if head.count() < FIRST_ROWS:
        done = list(range(len(names)))
    else:
        # at the last key there may be more rows than were taken
        last = head.agg(F.max(_order(key)).alias("last"), F.count_if(_order(key).isNull()).alias("nulls"))
        counts = counts.crossJoin(F.broadcast(last)).where((F.col("nulls") == 0) & (F.col("first") < F.col("last"))).drop("last", "nulls")
        seen = counts.groupBy("pos").agg(F.count(F.lit(1)).alias("values")).where(F.col("values") >= n)
        done = [r["pos"] for r in seen.collect()]
    rest = [i for i in range(len(names)) if i not in done]
    parts = ["pos", "rank", "value"]
    found = top_values(head, counts.where(F.col("pos").isin(done)), order, n, names).select(*parts)
    if not rest:
        return found
    others = [names[i] for i in rest]
    late = top_values(df, value_counts(df, key, others), order, n, others).select(*parts)
    back = F.element_at(F.array(*map(F.lit, rest)), F.col("pos") + 1)
    return found.unionByName(late.withColumn("pos", back))


def column_samples(
    df: DataFrame,
    key: str | Sequence[str] | None = None,
    n: int = SAMPLES,
    columns: Sequence[str] | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """First ``n`` distinct values of each column in row order, repeated to fill ``n``."""
    # without a key the first value is the smallest
    order = [] if key is None else [F.col("first").asc_nulls_last()]
    if counts is None and key is not None:
        first = _first_values(df, key, n, columns, order)
    else:
        counts = value_counts(df, key, columns) if counts is None else counts
        first = top_values(df, counts, order, n, columns)
    found = (
        first.groupBy("pos")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("_pairs"))
        .select("pos", F.col("_pairs.value").alias("_found"))
    )
    listed = columns_frame(df, columns).join(F.broadcast(found), "pos", "left")
    filled = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.get(F.col("_found"), i % F.size("_found")),
    )
    return listed.select(
        "pos",
        "column",
        "dtype",
        "is_numeric_dtype",
        F.when(F.size("_found") > 0, filled)
        .otherwise(F.array_repeat(F.lit("NaN"), n))
        .alias("samples"),
        F.coalesce(F.size("_found") > 0, F.lit(False)).alias("has_values"),
    )


def sample_shape(samples: DataFrame) -> DataFrame:
    """Word, character, space, delimiter and stop-word statistics plus pattern flags."""
    return S.with_shape(samples)


def profile(
    df: DataFrame,
    key: str | Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The full profile, one row per column."""
    counts = value_counts(df, key, columns)
    stats = column_stats(df, columns, counts=counts)
    shaped = sample_shape(column_samples(df, key, columns=columns, counts=counts))
    return stats.join(
        F.broadcast(shaped.drop("column", "dtype", "is_numeric_dtype")), "pos"
    )


def profile_catalog(tables: dict[str, tuple[DataFrame, str | Sequence[str] | None]]) -> DataFrame:
    """Profiles of several tables in one frame with a ``table`` column."""
    union = None
    for name, (df, key) in tables.items():
        one = profile(df, key).select(F.lit(name).alias("table"), "*")
        union = one if union is None else union.unionByName(one)
    return union


def first_values(df: DataFrame, key: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """First non-missing value of each column in row order."""
    fields = _columns(df, columns)
    order = _order(key)
    aggs = [
        F.min_by(cell_text(f), F.when(cell_text(f).isNotNull(), order)).alias(f"v{i}")
        for i, f in enumerate(fields)
    ]
    rows = [
        F.struct(
            F.lit(i).alias("pos"),
            F.lit(f.name).alias("column"),
            F.lit(value_type_name(f)).alias("dtype"),
            F.col(f"v{i}").alias("value"),
        )
        for i, f in enumerate(fields)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def first_value_castable(df: DataFrame, key, columns=None) -> DataFrame:
    """1 when the first non-missing value is text that reads as a literal, else 0."""
    value = F.col("value")
    quoted = value.rlike(r"""^\s*('[^']*'|"[^"]*")\s*$""")
    named = F.trim(value).isin("True", "False", "None")
    nested = value.rlike(r"^\s*[\[{]") & F.try_parse_json(value).isNotNull()
    hit = (F.col("dtype") == "string") & (value.rlike(S.PLAIN_NUMBER) | quoted | named | nested)
    return first_values(df, key, columns).select(
        "column", F.coalesce(hit, F.lit(False)).cast("int").alias("castable")
    )


def first_value_has_number(df: DataFrame, key, columns=None) -> DataFrame:
    """1 when the first non-missing value is text holding exactly one plain number."""
    kept = F.trim(F.regexp_replace("value", r"[^0-9. ]", " "))
    hit = (F.col("dtype") == "string") & kept.rlike(r"^(\d+\.?\d*|\.\d+)$")
    return first_values(df, key, columns).select(
        "column", F.coalesce(hit, F.lit(False)).cast("int").alias("has_number")
    )


def mean_sample_tokens(samples: DataFrame) -> DataFrame:
    """Mean number of whitespace-separated tokens over the samples."""
    tokens = S.per_sample(
        "samples", lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    )
    return samples.select("column", S.array_mean(tokens).alias("mean_tokens"))


def category_size(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    counts: DataFrame | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Binary, small, large or none: how categorical a column looks.

    Only the sizes of the 20 most frequent values matter, not which values they are,
    so no values are sorted: ``sizes`` of the counts are.
    """
    if sizes is None:
        sizes = count_sizes(value_counts(df, None, columns) if counts is None else counts)
    window = Window.partitionBy("pos").orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(20) - F.coalesce(F.sum("values").over(window), F.lit(0)), F.lit(0))
    totals = sizes.withColumn("_taken", F.least("values", left)).groupBy("pos").agg(
        F.sum("values").alias("num_of_dist_val"),
        F.sum(F.col("n") * F.col("values")).alias("non_null"),
        F.sum(F.col("n") * F.col("_taken")).alias("top"),
    )
    joined = columns_frame(df, columns).join(F.broadcast(totals), "pos", "left")
    distinct = F.coalesce("num_of_dist_val", F.lit(0))
    size = (
        F.when(distinct <= 2, "binary")
        .when((distinct <= 20) & (distinct / F.col("non_null") < 0.3), "small")
        .when(F.col("top") / F.col("non_null") > 0.8, "large")
        .otherwise("none")
    )
    return joined.select("pos", "column", size.alias("category_size"))


def number_shares(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of the non-missing cells of each column that parse as numbers.

    Numbers always do, truth values and times never: their cells are counted, not
    written out as text.
    """
    fields = _columns(df, columns)
    aggs, rows = [], []
    for i, f in enumerate(fields):
        kind = value_type_name(f)
        if kind == "string":
            numbers = F.when(cell_text(f).rlike(S.PLAIN_NUMBER), 1)
        else:
            numbers = clean(f) if kind in ("integer", "floating") else F.lit(None)
        filled = clean(f) if kind != "string" or isinstance(f.dataType, T.StringType) else cell_text(f)
        aggs += [F.count(filled).alias(f"c{i}"), F.count(numbers).alias(f"n{i}")]
        rows.append(
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(f.name).alias("column"),
                F.coalesce(
                    F.try_divide(F.col(f"n{i}").cast("double"), F.col(f"c{i}").cast("double")),
                    F.lit(0.0),
                ).alias("number_share"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def mixed_columns(df: DataFrame, key: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Columns holding both numbers and text, with the first text cells to show instead.

    One pass finds the mixed columns (a flag per column reaches the driver); only
    their cells are looked at again.
    """
    fields = _columns(df, columns)
    shares = durable(number_shares(df, columns)).withColumn(
        "is_mixed", (F.col("number_share") > 0) & (F.col("number_share") < 1)
    )
    mixed = [r["pos"] for r in shares.filter("is_mixed").select("pos").collect()]
    none = F.array().cast("array<string>")
    if not mixed:
        return shares.withColumn("override", none)
    cells = F.array(*[
        F.struct(F.lit(i).alias("pos"), cell_text(fields[i]).alias("value")) for i in mixed
    ])
    words = (
        df.select(_order(key).alias("ord"), F.inline(cells))
        .filter(F.col("value").isNotNull() & ~is_number(F.col("value")))
    )
    firsts = top_per_group(words, ["pos"], [F.col("ord"), F.col("value")], SAMPLES, spread=["ord"])
    override = firsts.groupBy("pos").agg(
        F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("_o")
    ).select("pos", F.col("_o.value").alias("override"))
    return shares.join(F.broadcast(override), "pos", "left").withColumn(
        "override", F.coalesce("override", none)
    )


def apply_override(profiles: DataFrame, mixed: DataFrame) -> DataFrame:
    """Put the text cells of mixed columns over the first samples of a profile."""
    pairs = F.transform(
        F.col("samples"), lambda s, i: F.coalesce(F.get(F.col("override"), i), s)
    )
    return (
        profiles.join(F.broadcast(mixed.select("pos", "override", "is_mixed")), "pos", "left")
        .withColumn("samples", F.when(F.size("override") > 0, pairs).otherwise(F.col("samples")))
        .drop("override")
    )


def value_types(df: DataFrame, key: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Value type per column, where a text column with some numbers is ``mixed``."""
    listed = columns_frame(df, columns)
    shares = number_shares(df, columns).drop("column")
    kind = F.when(
        (F.col("dtype") == "string") & (F.col("number_share") > 0) & (F.col("number_share") < 1),
        "mixed",
    ).otherwise(F.col("dtype"))
    return listed.join(F.broadcast(shares), "pos").select("column", kind.alias("value_type"))


def numeric_fields(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Which columns are numeric, and how many of their cells are filled."""
    fields = _columns(df, columns)
    stats = _moments(df, fields, approx=False)
    return stats.select(
        "column",
        F.col("is_numeric_dtype").alias("is_numeric"),
        (F.col("total_vals") - F.col("num_nans")).alias("non_null"),
    )


def numeric_samples(samples: DataFrame) -> DataFrame:
    """True where all samples of a column parse as numbers."""
    return samples.select(
        "column", F.forall("samples", lambda s: is_number(s)).alias("all_numeric")
    )


def sample_digits(samples: DataFrame) -> DataFrame:
    """Digits, signed-number tokens and commas in the samples."""
    return samples.select("column", *S.digit_columns())

