"""Dates held in text: common western spellings and Japanese eras."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.cells import let

# Era name, letter, square symbol, first year, last day.
ERAS = (
    ("明治", "M", "㍾", 1868, "1912-07-29"),
    ("大正", "T", "㍽", 1912, "1926-12-24"),
    ("昭和", "S", "㍼", 1926, "1989-01-07"),
    ("平成", "H", "㍻", 1989, "2019-04-30"),
    ("令和", "R", "㋿", 2019, "9999-12-31"),
)
FIRST_DAY = "1868-01-25"

# Part names of the two dialects, in output order.
WESTERN_PARTS = ("year", "month", "day", "weekday", "hour", "minute", "second")
JAPANESE_PARTS = ("年", "月", "日", "曜日", "時", "分", "秒")

MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
CLOCK = r"(?:[T ]+(\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d+)?)?)(?: ?(?:Z|UTC|[+-]\d{2}:?\d{2}))?)?"
YEAR_FIRST = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + CLOCK + "$"
YEAR_LAST = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})" + CLOCK + "$"
COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
YEAR_MONTH = r"^(\d{4})[-/](\d{1,2})$"
NAMED_FIRST = r"^([A-Za-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})" + CLOCK + "$"
NAMED_SECOND = r"^(\d{1,2})[ -]([A-Za-z]{3})[a-z]*\.?,?[ -](\d{4})" + CLOCK + "$"
YEAR_ONLY = r"^((?:1[5-9]|2[01])\d{2})$"
NAMED_MONTH = r"^([A-Za-z]{3})[a-z]*\.?,? (\d{4})$"
DAY_NAME = r"^(?i)(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? +(?=[A-Za-z\d])"
#: A year of two digits, from 1969 to 2068.
THIS_CENTURY = r"^(\d{1,2}[-/.]\d{1,2}[-/.])([0-5]\d|6[0-8])(?=$|[T ])"
LAST_CENTURY = r"^(\d{1,2}[-/.]\d{1,2}[-/.])(69|[7-9]\d)(?=$|[T ])"
HALF_DAY = r"(?i)(\d{1,2})(:\d{2}(?::\d{2}(?:\.\d+)?)?) ?([ap])\.?m\.?$"
DATE_SHAPED = r"^\d{4}-(\d{1,2}|[A-Za-z]{3})-\d{1,2}( \d{1,2}:[0-9:.]+)? ?$"


def _full_day(text: Column) -> Column:
    """A clock with am or pm as one of 24 hours; a day's name and a short year spelled out."""
    hour = F.regexp_extract(text, HALF_DAY, 1).try_cast("int")
    late = F.when(F.lower(F.regexp_extract(text, HALF_DAY, 3)) == "p", F.lit(12)).otherwise(F.lit(0))
    clock = F.concat((hour % 12 + late).cast("string"), F.regexp_extract(text, HALF_DAY, 2))
    day = F.regexp_replace(text, HALF_DAY, "")
    text = F.when(hour.between(1, 12), F.concat(day, clock)).otherwise(text)
    text = F.regexp_replace(text, DAY_NAME, "")
    return F.regexp_replace(F.regexp_replace(text, THIS_CENTURY, "$120$2"), LAST_CENTURY, "$119$2")


def _iso(text: Column) -> Column:
    """Rewrite the accepted spellings as year-month-day, the month maybe still named."""
    for pattern, order in (
        (YEAR_FIRST, "$1-$2-$3 $4"),
        (COMPACT, "$1-$2-$3"),
        (YEAR_MONTH, "$1-$2-1"),
        (YEAR_ONLY, "$1-1-1"),
        (NAMED_MONTH, "$2-$1-1"),
        (NAMED_FIRST, "$3-$1-$2 $4"),
        (NAMED_SECOND, "$3-$2-$1 $4"),
    ):
        text = F.regexp_replace(text, pattern, order)
    return text


def _read_iso(iso: Column) -> Column:
    name = F.regexp_extract(iso, "-([A-Za-z]{3})-", 1)
    at = F.instr(F.lit(MONTHS), F.lower(name)) + 2
    month = F.when(at % 3 == 0, F.concat(F.lit("-"), F.floor(at / 3), F.lit("-"))).otherwise("-0-")
    numbered = F.when(name != "", F.regexp_replace(iso, "-[A-Za-z]{3}-", month)).otherwise(iso)
    return F.try_to_timestamp(F.trim(numbered))


def parse_date(col: Column) -> Column:
    """Timestamp of a western date text, null when it cannot be read.

    A zone suffix is accepted and the local clock time kept. ``a/b/yyyy`` is read
    month first, and day first only when that gives no date. Two digits are a year
    from 1969 to 2068; a missing day or month is the first.
    """

    return let(_western_text(col.cast("string")), lambda text: let(_iso(text), _read_western))


def _western_text(text: Column) -> Column:
    """The trimmed text if it may be a western date, with odd clocks and short years spelled out."""
    trimmed = F.trim(text)
    likely = text.rlike(r"^\s*(\d|[A-Za-z]{3,9}\.?,? [\dA-Za-z])")
    odd = trimmed.rlike(rf"{HALF_DAY}|{DAY_NAME}|{THIS_CENTURY}|{LAST_CENTURY}")
    return F.when(likely & odd, _full_day(trimmed)).when(likely, trimmed)


def _read_western(text: Column) -> Column:
    iso = F.regexp_replace(text, YEAR_LAST, "$3-$1-$2 $4")
    swapped = F.regexp_replace(text, YEAR_LAST, "$3-$2-$1 $4")
    return F.when(iso.rlike(DATE_SHAPED), F.coalesce(_read_iso(iso), _read_iso(swapped)))


def _plain_digits(text: Column) -> Column:
    text = F.replace(text, F.lit("元年"), F.lit("1年"))
    text = F.translate(text, "〇一二三四五六七八九", "0123456789")
    text = F.regexp_replace(text, r"(\d)十(\d)", "$1$2")
    text = F.regexp_replace(text, r"(\d)十", "$10")
    text = F.regexp_replace(text, r"十(\d)", "1$1")
    return F.replace(text, F.lit("十"), F.lit("10"))


def ascii_width(col: Column) -> Column:
    """Full-width digits, letters and marks to ASCII, and kanji numbers to digits."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    narrow = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
    text = col.cast("string")
    text = F.when(text.rlike("[！-～　]"), F.translate(text, wide, narrow)).otherwise(text)
    return F.when(text.rlike("[〇一二三四五六七八九十元]"), _plain_digits(text)).otherwise(text)


ERA_MARKS = "|".join(mark for name, letter, square, *_ in ERAS for mark in (name, letter, square))


ERA_TABLE = "map(" + ", ".join(
    f"'{mark}', named_struct('begin', {era[3]}, 'last', TIMESTAMP'{era[4]}')"
    for i, era in enumerate(ERAS)
    for mark in (*era[:3], str(i + 1))
) + ")"


def _read_era(text: Column) -> Column:
    """Split a normalised text into its era and the numbers that follow."""
    mark = F.regexp_extract(text, f"^({ERA_MARKS})", 1)
    packed = f"^({ERA_MARKS}|[1-5])(\\d{{2}})(\\d{{2}})(\\d{{2}})$"
    spaced = F.regexp_replace(F.regexp_replace(text, packed, "$2 $3 $4"), f"^({ERA_MARKS})", "")
    numbers = F.transform(
        F.regexp_extract_all(spaced, F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("int")
    )
    code = F.regexp_extract(text, r"^([1-5])\d{6}$", 1)
    found = F.concat(mark, code)
    # A date without a year belongs to the first year of the latest era.
    no_year = (found == "") & ~text.contains("年")
    given = F.when(no_year, F.concat(F.array(F.lit(1)), numbers)).otherwise(numbers)
    short = (F.size(given) == 2) & ~text.contains("日")
    return F.struct(
        found.alias("found"),
        F.try_element_at(F.expr(ERA_TABLE), found).alias("era"),
        ((found != "") | text.rlike("[年月日]")).alias("japanese"),
        F.when(short, F.concat(given, F.array(F.lit(1)))).otherwise(given).alias("n"),
    )


def _era_stamp(read: Column) -> Column:
    era, n = read["era"], read["n"]
    number = F.get(n, F.lit(0))
    western = era.isNull() & (number >= 1000)
    begin = F.when(western, F.lit(1)).otherwise(F.coalesce(era["begin"], F.lit(ERAS[-1][3])))
    filled = F.concat(n, F.expr("array(0, 0, 0)"))
    stamp = F.try_make_timestamp(number + begin - 1, *[F.get(filled, F.lit(i)) for i in range(1, 6)])
    usable = read["japanese"] & F.size(n).between(3, 6) & (number > 0)
    return F.when(usable, stamp)


def _within_era(read: Column, stamp: Column) -> Column:
    era = read["era"]
    known = (stamp >= F.lit(FIRST_DAY).cast("timestamp")) & (era.isNull() | (stamp <= era["last"]))
    return F.when(known, stamp)


def _maybe_era(text: Column) -> Column:
    return text.rlike(rf"^\s*({ERA_MARKS})|[年月日]|^\s*[1-5１-５]([0-9０-９]{{6}})\s*$")


def parse_era(col: Column) -> Column:
    """Timestamp of a Japanese date text, null when it cannot be read.

    Reads era names, letters or square symbols with 2 to 6 numbers, era letter
    plus yymmdd, era number plus yymmdd, and unmarked 年月日 dates, where a
    four-digit year is western and a shorter one belongs to the latest era.
    """
    def read(parsed: Column) -> Column:
        return let(_era_stamp(parsed), lambda stamp: _within_era(parsed, stamp))

    return F.when(
        _maybe_era(col.cast("string")),
        let(F.trim(ascii_width(col)), lambda text: let(_read_era(text), read)),
    )


def reads_as_date(col: Column) -> Column:
    return F.coalesce(parse_date(col).isNotNull() | parse_era(col).isNotNull(), F.lit(False))


def date_value(col: Column, dialect: str = "western") -> Column:
    """Timestamp of a date cell; ``None`` text and unreadable cells are null."""
    text = F.when(col.cast("string") != "None", col.cast("string"))
    if dialect == "japanese":
        return F.coalesce(parse_era(text), parse_date(text))
    return parse_date(text)


def with_stamps(df: DataFrame, columns: dict[str, str], japanese: Sequence[str] = ()) -> DataFrame:
    """``df`` with a timestamp column for each text column: ``columns`` maps text to stamp.

    The same values as ``date_value``, with every step a column of its own, so that
    each is made once and inside generated code.
    """
    def step(made: dict[str, Column]) -> None:
        nonlocal df
        df = df.withColumns(made)

    era = [c for c in columns if c in japanese]
    text = {c: F.col(f"`{c}`").cast("string") for c in columns}
    step({f"_text_{c}": F.when(t != "None", t) for c, t in text.items()})
    at = lambda name, c: F.col(f"`_{name}_{c}`")
    if era:
        step({f"_wide_{c}": F.when(_maybe_era(at("text", c)), F.trim(ascii_width(at("text", c)))) for c in era})
        step({f"_read_{c}": F.when(at("wide", c).isNotNull(), _read_era(at("wide", c))) for c in era})
        step({f"_time_{c}": _era_stamp(at("read", c)) for c in era})
        step({f"_era_{c}": _within_era(at("read", c), at("time", c)) for c in era})
    left = {c: F.when(at("era", c).isNull(), at("text", c)) if c in era else at("text", c) for c in columns}
    step({f"_full_{c}": _western_text(left[c]) for c in columns})
    step({f"_iso_{c}": _iso(at("full", c)) for c in columns})
    step({f"_day_{c}": _read_western(at("iso", c)) for c in columns})
    step({out: F.coalesce(at("era", c), at("day", c)) if c in era else at("day", c) for c, out in columns.items()})
    names = [f"_{n}_{c}" for c in columns for n in ("text", "wide", "read", "time", "era", "full", "iso", "day")]
    return df.drop(*names)


def date_parts(stamp: Column) -> list[Column]:
    """Year, month, day, weekday (Monday is 0), hour, minute and second."""
    return [
        F.year(stamp),
        F.month(stamp),
        F.dayofmonth(stamp),
        F.weekday(stamp),
        F.hour(stamp),
        F.minute(stamp),
        F.second(stamp),
    ]


def has_wide_text(col: Column) -> Column:
    """True for a cell with a character outside ASCII."""
    return F.length(col) != F.octet_length(col)
