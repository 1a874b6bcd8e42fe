"""Expressions over one cell: missing values and numbers held in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a number in text.
FINITE_NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"
SPECIAL_NUMBER = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"

# Texts that stand for a missing cell.
SENTINELS = ("x", "-", "-99999")


def is_numeric_field(field: T.StructField) -> bool:
    """Numbers and booleans count as numeric."""
    return isinstance(field.dataType, (T.NumericType, T.BooleanType))


def clean(field: T.StructField) -> Column:
    """The column with NaN and infinities turned into null, and -0.0 into 0.0."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        bad = F.isnan(column) | (F.abs(column) == F.lit(float("inf")))
        return F.when(~bad, column + F.lit(0.0).cast(field.dataType))
    return column


def cell_text(field: T.StructField) -> Column:
    """Text form of a cell; nested values as JSON."""
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.col(f"`{field.name}`"))
    return clean(field).cast("string")


def is_number(col: Column) -> Column:
    """True when the text parses as one floating-point number (nan and inf too)."""
    text = col.cast("string")
    return text.rlike(FINITE_NUMBER) | text.rlike(SPECIAL_NUMBER)


def to_number(col: Column) -> Column:
    """The finite number a text holds, else null."""
    text = col.cast("string")
    plain = F.trim(F.regexp_replace(text, r"[_\s]", ""))
    return F.when(text.rlike(FINITE_NUMBER), plain.try_cast("double"))


def digits_number(col: Column) -> Column:
    """Keep digits and dots and read them as one number; 0 when that fails."""
    kept = F.regexp_replace(col, r"[^0-9.]", "")
    valid = kept.rlike(r"^(\d+\.?\d*|\.\d+)$")
    return F.when(valid, kept.try_cast("double")).otherwise(F.lit(0.0))


def embedded_number(col: Column) -> Column:
    """The number inside a text such as ``USD12.50/ea``; the sign is not kept."""
    text = col.cast("string")
    missing = text.isNull() | text.rlike(SPECIAL_NUMBER)
    return F.when(~missing, digits_number(text))


def comma_number(col: Column) -> Column:
    """Numeric value of text that uses commas as thousands separators."""
    return to_number(F.regexp_replace(col.cast("string"), ",", ""))


def null_sentinel(col: Column, values=SENTINELS) -> Column:
    """Null where the cell is one of the stand-ins for a missing value."""
    return F.when(~F.trim(col.cast("string")).isin(*values), col)


def display_missing_pct(nulls: Column, total: Column) -> Column:
    """Whole percent of missing cells, where anything between 0 and 1 shows as 1."""
    pct = nulls.cast("double") * 100.0 / (total.cast("double") + F.lit(1e-9))
    return F.when((pct > 0) & (pct < 1), F.lit(1).cast("bigint")).otherwise(F.floor(pct))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
