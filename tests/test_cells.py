"""Cell-level rules against plain statements of the same rule, on generated texts."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.functions import cells, dates, parts
from tablewright.functions.text import (
    fenced_code,
    lenient_json,
    line_body,
    markup_lines,
    trim_to_format,
)

SLOW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
CELL = st.text(alphabet="0123456789.-+ eEkgm<>~/_abtoinf", max_size=12)
CELLS = st.lists(CELL, min_size=40, max_size=80)


def column_of(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def evaluate(spark, values, *exprs):
    rows = column_of(spark, values).select("x", *[e.alias(f"r{i}") for i, e in enumerate(exprs)]).collect()
    return [tuple(r) for r in rows]


def as_float(text):
    try:
        return float(text)
    except ValueError:
        return None


def digits_only(text):
    found = as_float(re.sub(r"[^0-9.]", "", text))
    return 0.0 if found is None else found


@SLOW
@given(CELLS)
def test_is_number_follows_float(spark, values):
    for text, got in evaluate(spark, values, cells.is_number(F.col("x"))):
        assert got == (as_float(text) is not None), text


@SLOW
@given(CELLS)
def test_embedded_number_keeps_digits_and_dots(spark, values):
    for text, got in evaluate(spark, values, cells.embedded_number(F.col("x"))):
        special = as_float(text)
        if special is not None and (special != special or abs(special) == float("inf")):
            continue
        assert got == digits_only(text), text


@SLOW
@given(CELLS)
def test_range_ends(spark, values):
    start, end = parts.range_ends(F.col("x"))
    for text, a, b in evaluate(spark, values, start, end):
        if as_float(text) is not None:
            continue
        found = re.search(r"(-?\d*\.?\d+)\D+(-?\d*\.?\d+)", text)
        want = (float(found[1]), float(found[2])) if found else (digits_only(text),) * 2
        assert (a, b) == want, text


@SLOW
@given(st.lists(st.text(alphabet="htps:/w.ab;?#&=-@", max_size=25), min_size=40, max_size=80))
def test_url_parts(spark, values):
    whole = re.compile(r"^(?:([^:/?#]+):)?(//([^/?#]*))?([^?#]*)")
    for text, domain, path, last, depth in evaluate(spark, values, *parts.url_parts(F.col("x"))):
        found = whole.match(text)
        host = found[3] or ""
        if host.startswith("www") and len(host) > 3:
            host = host.replace("www.", "")
        if not host:
            assert (domain, path, last, depth) == parts.NO_URL
            continue
        want = re.sub(r";[^/]*$", "", found[4])
        pieces = want.split("/")
        assert (domain, path) == (host, want)
        assert last == (pieces[-1] if want else "NA")
        assert depth == sum(1 for p in pieces if p)


def test_numbers_with_letters_are_not_numbers(spark):
    got = dict(evaluate(spark, ["5d", "5f", "0x1", "1e5", " 7 ", "NaN", "-inf", ""], cells.is_number(F.col("x"))))
    assert got == {"5d": False, "5f": False, "0x1": False, "1e5": True, " 7 ": True, "NaN": True, "-inf": True, "": False}


@pytest.mark.parametrize("text, want", [
    ("平成３年３月２３日", "1991-03-23"),
    ("平成三年三月二十三日", "1991-03-23"),
    ("令和元年5月1日", "2019-05-01"),
    ("4030323", "1991-03-23"),
    ("S22.9.11", "1947-09-11"),
    ("平成3年3月", "1991-03-01"),
    ("2020年3月5日", "2020-03-05"),
    ("平成31年5月1日", None),
    ("東京", None),
    ("1991-3-23", "1991-03-23"),
    ("None", None),
])
def test_japanese_dates(spark, text, want):
    ((_, got),) = evaluate(spark, [text], dates.date_value(F.col("x"), "japanese").cast("date").cast("string"))
    assert got == want


@pytest.mark.parametrize("text, want", [
    ("2020-02-29", "2020-02-29 00:00:00"),
    ("2/13/2020 07:30", "2020-02-13 07:30:00"),
    ("13/02/2020", "2020-02-13 00:00:00"),
    ("Jan 5, 2021", "2021-01-05 00:00:00"),
    ("5 March 2021", "2021-03-05 00:00:00"),
    ("20200230", None),
    ("2024-13-01", None),
    ("5", None),
])
def test_western_dates(spark, text, want):
    ((_, got),) = evaluate(spark, [text], dates.parse_date(F.col("x")).cast("string"))
    assert got == want


def test_missing_unit_cells_stay_missing(spark):
    got = evaluate(spark, [None, "nan", "5 kg"], parts.unit_amount(F.col("x")), parts.unit_residue(F.col("x")))
    assert got == [(None, None, None), ("nan", None, None), ("5 kg", 5000.0, "kg")]


def test_both_less_than_words_match(spark):
    got = dict(evaluate(spark, ["Smaller than 5", "<5", "<= 5", "over 5", "about 5"], parts.sign_amount(F.col("x"))))
    assert got == {"Smaller than 5": 4.0, "<5": 4.0, "<= 5": 4.0, "over 5": 6.0, "about 5": 5.0}


def test_list_brackets_leave_no_empty_element(spark):
    got = dict(evaluate(spark, ["['a', 'b']", None, "x;y z"], parts.list_elements(F.col("x"))))
    assert got == {"['a', 'b']": ["a", "b"], None: ["0"], "x;y z": ["x", "y", "z"]}


def test_line_body_keeps_later_colons(spark):
    assert dict(evaluate(spark, ["I_0: sum: 5", "plain"], line_body(F.col("x")))) == {"I_0: sum: 5": "sum: 5", "plain": None}


def test_text_helpers(spark):
    code = fenced_code(F.col("x"))
    got = dict(evaluate(spark, ["a\n```python\nprint(1)\n```", "<think>t</think><answer>4</answer>", "x"], code))
    assert list(got.values()) == ["print(1)", "4", "x"]
    parsed = evaluate(spark, ['```json\n{"a": "[1]"}\n```', "nope"], lenient_json(F.col("x")).getField("ok"))
    assert [r[1] for r in parsed] == [True, False]
    markup = evaluate(spark, ["<a> one <b>two</b></a>tail"], markup_lines(F.col("x")))
    assert markup[0][1] == "one\ntwo\ntail"
    trimmed = evaluate(spark, ["pre @v 42\n"], trim_to_format(F.lit("How many? Format: @v"), F.col("x")))
    assert trimmed[0][1] == " 42"


def test_missing_percentage_display(spark):
    shown = cells.display_missing_pct(F.col("x").cast("bigint"), F.lit(1000))
    assert [r[1] for r in evaluate(spark, ["0", "1", "15", "1000"], shown)] == [0, 1, 1, 99]
