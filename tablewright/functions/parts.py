"""Expressions that take one formatted cell apart: URLs, lists, units, signs, ranges, IDs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.cells import SPECIAL_NUMBER, digits_number, is_number, let, to_number

# Factor of each unit spelling (case matters).
UNIT_FACTORS = {
    "g": 1,
    "grams": 1,
    "gram": 1,
    "kg": 1000,
    "kilograms": 1000,
    "kilogram": 1000,
    "t": 1000000,
    "tonne": 1000000,
    "mg": 0.001,
    "cm": 0.01,
    "centimeters": 0.01,
    "centimeter": 0.01,
    "m": 1,
    "meter": 1,
    "meters": 1,
    "km": 1000,
    "kilometers": 1000,
    "kilometer": 1000,
    "year": 365,
    "yr": 365,
    "years": 365,
    "month": 30,
    "months": 30,
    "days": 1,
    "day": 1,
    "mm": 0.001,
    "K": 1000,
    "M": 1000000,
    "グラム": 1,
    "キログラム": 1000,
    "ミリグラム": 0.001,
    "トン": 1000000,
    "メートル": 1,
    "キロメートル": 1000,
    "ミリメートル": 0.001,
    "年": 365,
    "月": 30,
    "日": 1,
    "週": 7,
    "分": 60,
    "秒": 1,
    "キロバイト": 1000,
    "メガバイト": 1000000,
    "ギガバイト": 1000000000,
}

# Words and marks for below and above, compared in lower case.
BELOW_WORDS = ("less than", "smaller than", "<", "<=", "lt")
ABOVE_WORDS = ("greater than", "larger than", ">", ">=", "over", "gt", "+")

# What a URL without an authority turns into.
NO_URL = ("example.com", "/example/example/", "example", 3)

URI = r"^(?:([^:/?#]+):)?(//([^/?#]*))?([^?#]*)"
RANGE = r"(-?\d*\.?\d+)\D+(-?\d*\.?\d+)"
NUMBER_RUN = r"\d+(?:\.\d+)?"
LIST_GAP = r"[^0-9a-zA-Z_-]+"
ID_GAP = r"[^0-9a-zA-Z.]+"


def url_parts(col: Column) -> tuple[Column, Column, Column, Column]:
    """Domain without ``www.``, path, last path piece and depth of a URL."""
    text = F.coalesce(col.cast("string"), F.lit("NA"))
    authority = F.regexp_extract(text, URI, 3)
    domain = F.when(
        authority.rlike("^www."), F.regexp_replace(authority, r"www\.", "")
    ).otherwise(authority)
    path = F.regexp_replace(F.regexp_extract(text, URI, 4), r";[^/]*$", "")
    pieces = F.split(path, "/")
    last = F.when(path == "", F.lit("NA")).otherwise(F.element_at(pieces, -1))
    depth = F.size(F.filter(pieces, lambda p: p != ""))
    found = (domain, path, last, depth)
    return tuple(
        F.when(domain == "", F.lit(default)).otherwise(value)
        for default, value in zip(NO_URL, found)
    )


def list_elements(col: Column) -> Column:
    """Elements of a bracketed or separated list text; null counts as ``0``."""
    bare = F.regexp_replace(F.coalesce(col.cast("string"), F.lit("0")), r"^\[+|\]+$|'", "")
    return F.filter(F.split(bare, LIST_GAP), lambda e: e != "")


def unit_residue(col: Column) -> Column:
    """What is left of a cell without numbers and spaces; null for missing cells."""
    text = col.cast("string")
    return F.when(
        ~text.rlike(SPECIAL_NUMBER), F.regexp_replace(text, NUMBER_RUN + r"|\s", "")
    )


def plain_amount(col: Column) -> Column:
    """Digits of a cell as a number, null for missing cells."""
    text = col.cast("string")
    return F.when(~text.rlike(SPECIAL_NUMBER), digits_number(text))


def unit_amount(col: Column, factors: dict[str, float] | None = None) -> Column:
    """Number times the factor of its unit; an unknown unit counts as 1."""
    table = UNIT_FACTORS if factors is None else factors
    pairs = [F.lit(v) for name, factor in table.items() for v in (name, float(factor))]
    unit = F.trim(F.regexp_replace(col.cast("string"), r"[0-9.]+", ""))
    factor = F.coalesce(F.try_element_at(F.create_map(*pairs), unit), F.lit(1.0))
    return plain_amount(col) * factor


def sign_amount(col: Column) -> Column:
    """Number one lower after a less-than word and one higher after a greater-than word."""
    sign = F.lower(F.trim(F.regexp_replace(col.cast("string"), NUMBER_RUN, "")))
    step = (
        F.when(sign.isin(*BELOW_WORDS), F.lit(-1.0))
        .when(sign.isin(*ABOVE_WORDS), F.lit(1.0))
        .otherwise(F.lit(0.0))
    )
    return plain_amount(col) + step


def has_range(col: Column) -> Column:
    """True when a cell that is not one number holds two numbers with text between."""
    text = col.cast("string")
    return F.coalesce(~is_number(text) & text.rlike(RANGE), F.lit(False))


def range_ends(col: Column) -> tuple[Column, Column]:
    """Start and end of a range cell; both the same for a single number."""
    text = col.cast("string")
    single = digits_number(text)

    def end(group: int) -> Column:
        return (
            F.when(is_number(text), to_number(text))
            .when(text.rlike(RANGE), F.regexp_extract(text, RANGE, group).try_cast("double"))
            .when(text.isNotNull(), single)
        )

    return end(1), end(2)


def _most_frequent(runs: Column) -> Column:
    """The text that occurs most often in an array, the first of them on ties."""
    ranked = F.transform(
        F.array_distinct(runs),
        lambda r: F.struct(
            F.size(F.filter(runs, lambda o: o == r)).alias("times"),
            (-F.array_position(runs, r)).alias("at"),
            r.alias("run"),
        ),
    )
    return F.when(F.size(runs) > 1, F.array_max(ranked)["run"])


def cell_separator(col: Column) -> Column:
    """The most frequent separator run of a cell with two or more runs, else null."""
    return let(F.regexp_extract_all(col.cast("string"), F.lit(ID_GAP), F.lit(0)), _most_frequent)


def text_part(col: Column, separator: str, i: int) -> Column:
    """Part ``i`` (from 0) of a cell split on a literal text, empty when missing."""
    text = col.cast("string")
    parts = F.split(text, re.escape(separator))
    return F.when(text.isNotNull(), F.coalesce(F.get(parts, F.lit(i)), F.lit("")))


def offset_parts(col: Column, offsets: list[int]) -> list[Column]:
    """Pieces of a cell between the given character offsets."""
    text = col.cast("string")
    edges = [0, *offsets]
    pieces = [
        F.substring(text, a + 1, max(b - a, 0)) for a, b in zip(edges, edges[1:])
    ]
    return [*pieces, F.substr(text, F.lit(edges[-1] + 1))]


def number_text_parts(col: Column) -> tuple[Column, Column]:
    """Digits and dots of a cell, and the rest of it."""
    text = col.cast("string")
    return F.regexp_replace(text, r"[^0-9.]", ""), F.regexp_replace(text, NUMBER_RUN, "")


def parse_split_spec(col: Column) -> Column:
    """Struct (option, offsets, separator) of a written split instruction.

    Option 1 splits at offsets, 2 at a separator, 3 not at all, 4 into number and
    text. The instruction reads ``Option: .. Reason: .. Where to split: [..]``.
    """
    head = F.split_part(col, F.lit("Reason: "), F.lit(1))
    named = F.regexp_extract(head, "([1-4])", 1)
    lowest = F.coalesce(
        *[F.when(head.contains(str(n)), F.lit(n)) for n in (1, 2, 3, 4)], F.lit(4)
    )
    where = F.regexp_extract(
        F.split_part(col, F.lit("Where to split: "), F.lit(2)), r"(\[.*?\])", 1
    )
    inner = F.regexp_replace(where, r"^\[+|\]+$", "")
    usable = (where != "") & (F.length(where) <= 20)
    items = F.transform(F.split(inner, ","), lambda x: F.trim(x))
    integers = F.forall(items, lambda x: x.rlike(r"^[+-]?\d+$"))
    option = (
        F.when(~usable | (named == ""), F.lit(4))
        .when((lowest == 1) & ~integers, F.lit(3))
        .otherwise(lowest)
    )
    return F.struct(
        option.cast("int").alias("option"),
        F.when(option == 1, F.transform(items, lambda x: x.try_cast("int"))).alias("offsets"),
        F.when(
            option == 2, F.regexp_replace(F.get(F.split(inner, ","), F.lit(0)), r"^'+|'+$", "")
        ).alias("separator"),
    )
