"""Tables described in text, one row or line per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.cells import cell_text, clean, display_missing_pct
from tablewright.operators import infer as I
from tablewright.operators.profile import (
    column_stats,
    number_shares,
    top_values,
    value_counts,
)
from tablewright.operators.ranking import top_per_group

MAX_CATEGORIES = 20
MAX_EXAMPLES = 10
# Fixed value: rows from which a sidecar table is described instead of listed.
MAX_LINES = 300


def ordinal(i: Column) -> Column:
    """1st, 2nd, 3rd, then nth, from a 0-based number."""
    return (
        F.when(i == 0, "1st")
        .when(i == 1, "2nd")
        .when(i == 2, "3rd")
        .otherwise(F.concat((i + 1).cast("string"), F.lit("th")))
    )


def _extremes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(pos, low, high) as text, compared in the column's own type."""
    aggs, rows = [], []
    for i, c in enumerate(columns):
        value = cell_text(df.schema[c]) if df.schema[c].dataType.typeName() in ("array", "map", "struct") else clean(df.schema[c])
        aggs += [F.min(value).alias(f"a{i}"), F.max(value).alias(f"z{i}")]
        rows.append(F.struct(
            F.lit(i).alias("pos"),
            F.col(f"a{i}").cast("string").alias("low"),
            F.col(f"z{i}").cast("string").alias("high"),
        ))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def describe_table(
    df: DataFrame,
    types: dict[str, int] | None = None,
    key: str | Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """(pos, column, type_name, value_type, missing_pct, detail, rows), one row per column.

    A text column that holds some numbers has the value type ``mixed``. NaN and
    infinities are missing. The detail is a range for numbers, first and last for dates, the categories
    (most frequent first, 20 at most) or ten examples; nothing for URLs.
    """
    names = df.columns if columns is None else list(columns)
    types = I.types_of(df, key, names) if types is None else types
    counts = value_counts(df, None, names)
    stats = column_stats(df, names, counts=counts)
    top = top_values(df, counts, [F.col("n").desc()], MAX_CATEGORIES, names)
    ranked = top.groupBy("pos").agg(
        F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("_top")
    ).select("pos", F.col("_top.value").alias("values"))
    codes = F.create_map(*[F.lit(x) for c in names for x in (c, types[c])])
    typed = (
        stats.withColumn("type", I.single_value_override(F.try_element_at(codes, F.col("column")), F.col("num_of_dist_val")))
        .join(F.broadcast(ranked), "pos", "left")
        .join(F.broadcast(_extremes(df, names)), "pos")
        .join(F.broadcast(number_shares(df, names).select("pos", "number_share")), "pos")
    )
    listed = F.array_join(F.coalesce("values", F.array().cast("array<string>")), ", ")
    examples = F.array_join(F.slice(F.coalesce("values", F.array().cast("array<string>")), 1, MAX_EXAMPLES), ", ")
    some = lambda c: F.coalesce(c, F.lit("none"))
    detail = (
        F.when(F.col("type") == I.NUMERIC, F.concat(F.lit("Value range is ["), some(F.col("low")), F.lit(", "), some(F.col("high")), F.lit("].")))
        .when(F.col("type") == I.DATETIME, F.concat(F.lit("Start date is "), some(F.col("low")), F.lit(", and end date is "), some(F.col("high")), F.lit(".")))
        .when(
            (F.col("type") == I.CATEGORICAL) & (F.col("num_of_dist_val") > MAX_CATEGORIES),
            F.concat(F.lit("Selected 20 categories are ["), listed, F.lit("].")),
        )
        .when(F.col("type") == I.CATEGORICAL, F.concat(F.lit("All categories are ["), listed, F.lit("].")))
        .when(F.col("type") == I.URL, F.lit(""))
        .otherwise(F.concat(F.lit("Selected 10 unique examples are ["), examples, F.lit("].")))
    )
    return typed.select(
        "pos",
        "column",
        I.type_name(F.col("type").cast("int")).alias("type_name"),
        F.when((F.col("dtype") == "string") & (F.col("number_share") > 0) & (F.col("number_share") < 1), "mixed")
        .otherwise(F.col("dtype")).alias("value_type"),
        display_missing_pct(F.col("num_nans"), F.col("total_vals")).alias("missing_pct"),
        detail.alias("detail"),
        F.col("total_vals").alias("rows"),
    )


def describe_lines(described: DataFrame) -> DataFrame:
    """(pos, line): the text line of every column."""
    line = F.concat(
        F.col("column"), F.lit(" (feature type: "), F.col("type_name"), F.lit(") (value type: "),
        F.col("value_type"), F.lit(") (ratio of missing values: "), F.col("missing_pct").cast("string"),
        F.lit("%)"), F.when(F.col("detail") != "", F.concat(F.lit(": "), F.col("detail"))).otherwise(F.lit("")),
    )
    return described.select("pos", "rows", line.alias("line"))


def describe_text(described: DataFrame) -> DataFrame:
    """One row with the whole description; its size follows the number of columns."""
    lines = describe_lines(described)
    return lines.agg(
        F.count(F.lit(1)).alias("n"),
        F.max("rows").alias("rows"),
        F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("_l"),
    ).select(
        F.concat(
            F.lit("Number of columns: "), F.col("n").cast("string"),
            F.lit("\nNumber of rows: "), F.col("rows").cast("string"), F.lit("\n"),
            F.array_join(F.col("_l.line"), "\n"),
        ).alias("text")
    )


def preview(df: DataFrame, key: str | Sequence[str], n: int = 10) -> DataFrame:
    """(position, line): the first rows by key as text."""
    names = [key] if isinstance(key, str) else list(key)
    head = df.orderBy(*names).limit(n)
    line = F.concat_ws(" ", *[F.coalesce(cell_text(f), F.lit("NaN")) for f in df.schema.fields])
    ranked = top_per_group(
        head.select(F.lit(0).alias("_g"), *names, line.alias("line")), ["_g"], [F.col(c) for c in names], n, rank="position"
    )
    return ranked.select("position", "line")


def describe_dataset(
    tables: Sequence[tuple[DataFrame, str, dict[str, int] | None]], metadata: DataFrame, head_only: bool = False
) -> DataFrame:
    """(position, text) per table: ordinal, title, description and table text.

    ``metadata`` has one row with a ``distribution`` array in table order;
    ``tables`` holds (table, key, types or none).
    """
    files = metadata.select(F.posexplode("distribution").alias("position", "file"))
    texts = None
    for i, (df, key, types) in enumerate(tables):
        if head_only:
            body = preview(df, key).agg(
                F.sort_array(F.collect_list(F.struct("position", "line"))).alias("_l")
            ).select(F.array_join(F.col("_l.line"), "\n").alias("text"))
        else:
            body = describe_text(describe_table(df, types, key))
        one = body.select(F.lit(i).alias("position"), "text")
        texts = one if texts is None else texts.unionByName(one)
    return files.join(F.broadcast(texts), "position").select(
        "position",
        F.concat(
            ordinal(F.col("position")), F.lit(" table\nDataset title: "), F.col("file.file_title"),
            F.lit("\nDataset description: "), F.col("file.file_description"),
            F.lit("\n\nHeaders and values:\n"), F.col("text"),
        ).alias("text"),
    )


def flatten_notes(df: DataFrame, name: str, notes: str) -> DataFrame:
    """Add ``note``: "name: item is value. ..." from a map of items to texts.

    Only the text before a slash is kept, except in the item ``values``; missing
    items are left out.
    """
    entries = F.filter(F.map_entries(F.col(notes)), lambda e: e["value"].isNotNull())
    sentences = F.transform(
        entries,
        lambda e: F.concat(
            e["key"], F.lit(" is "),
            F.when(e["key"] == "values", e["value"]).otherwise(F.split_part(e["value"], F.lit("/"), F.lit(1))),
            F.lit("."),
        ),
    )
    return df.withColumn("note", F.concat(F.col(name), F.lit(": "), F.array_join(sentences, " ")))


def describe_notes(df: DataFrame, name: str, text: str) -> DataFrame:
    """Add ``note``: "name: text" for columns with one plain description."""
    return df.withColumn("note", F.concat(F.col(name), F.lit(": "), F.col(text)))


def transcript_lines(df: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Add ``line``: "Q: .." for user turns and "A: .." for assistant turns; others drop out."""
    line = F.when(F.col(role) == "user", F.concat(F.lit("Q: "), F.col(text))).when(
        F.col(role) == "assistant", F.concat(F.lit("A: "), F.col(text), F.lit("\n"))
    )
    return df.withColumn("line", line).filter(F.col("line").isNotNull())


def image_answer(first: Column, count: Column) -> Column:
    """"1st image, 2nd image" for ``count`` images numbered from ``first`` (0-based)."""
    numbered = F.transform(
        F.sequence(first, first + count - 1), lambda i: F.concat(ordinal(i), F.lit(" image"))
    )
    return F.array_join(numbered, ", ")


def _joined_parts(lines: DataFrame, conv: str, turn: str, per_part: int) -> DataFrame:
    """Lines of a conversation joined in turn order, ``per_part`` turns to a part.

    A part is bounded however long the conversation, so no task gathers all of it.
    """
    part = F.floor(F.col(turn) / per_part).cast("bigint").alias("part")
    return (
        lines.groupBy(conv, part)
        .agg(F.sort_array(F.collect_list(F.struct(turn, "line"))).alias("_l"))
        .select(conv, "part", F.array_join(F.col("_l.line"), "\n").alias("text"))
    )


def question_lines(df: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Add ``line``: the text of user turns; others drop out."""
    return df.filter(F.col(role) == "user").withColumn("line", F.col(text))


def transcript(df: DataFrame, conv: str, turn: str, per_part: int, role: str = "role", text: str = "text") -> DataFrame:
    """(conv, part, text): the question and answer text of each conversation, ``per_part`` turns to a text.

    ``transcript_lines`` gives the same as rows, for conversations of any length.
    """
    return _joined_parts(transcript_lines(df, role, text), conv, turn, per_part)


def questions(df: DataFrame, conv: str, turn: str, per_part: int, role: str = "role", text: str = "text") -> DataFrame:
    """(conv, part, text): the questions of each conversation, one per line, ``per_part`` turns to a text."""
    return _joined_parts(question_lines(df, role, text), conv, turn, per_part)


def distinct_lines(df: DataFrame, key: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """(first, line): rows as pipe-joined text, nulls skipped, repeats once."""
    names = df.columns if columns is None else list(columns)
    cells = [F.replace(cell_text(df.schema[c]), F.lit("\n"), F.lit(",")) for c in names]
    order = F.col(key) if isinstance(key, str) else F.struct(*key)
    return (
        df.select(order.alias("ord"), F.concat_ws("|", *cells).alias("line"))
        .groupBy("line")
        .agg(F.min("ord").alias("first"))
        .select("first", "line")
    )


def sidecar_text(
    df: DataFrame, key: str | Sequence[str], columns: Sequence[str] | None = None, max_lines: int = MAX_LINES
) -> DataFrame:
    """Text of a sidecar table: its distinct lines with fewer than ``max_lines`` rows, else its description."""
    names = df.columns if columns is None else list(columns)
    if df.limit(max_lines).count() >= max_lines:
        return describe_text(describe_table(df, None, key, names))
    return listed_text(df, key, names)


def listed_text(df: DataFrame, key: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """One row with the header and the distinct lines of a table that is known to be short."""
    names = df.columns if columns is None else list(columns)
    lines = distinct_lines(df, key, names).agg(
        F.sort_array(F.collect_list(F.struct("first", "line"))).alias("_l")
    )
    return lines.select(F.concat_ws("\n", F.lit("|".join(names)), F.array_join(F.col("_l.line"), "\n")).alias("text"))
