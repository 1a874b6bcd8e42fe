"""Text helpers: markup, fenced code, lenient JSON, turns, formats and tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FENCE = "```"
#: Characters of a text that are cut into pieces at once.
BLOCK_CHARS = 1_000_000
#: Pieces of text whose token counts a task remembers before it starts afresh, and their greatest length.
KEPT_PIECES, KEPT_CHARS = 200_000, 48
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space and what follows it up to the next: no token of a byte-level vocabulary goes across its start.
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def visible_text(markup: Column) -> Column:
    """Markup without scripts, styles and comments, every tag as a line break."""
    bare = F.regexp_replace(markup, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "\n")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", "\n")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", "\n")


def text_blocks(markup: Column) -> Column:
    """The non-blank lines of visible text, trimmed."""
    lines = F.transform(F.split(visible_text(markup), "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: x != "")


def markup_lines(markup: Column) -> Column:
    """Text of every element on a line of its own, without blank lines."""
    lines = F.transform(
        F.split(F.regexp_replace(markup, r"(?s)<[^>]*>", "\n"), "\n"), lambda x: F.trim(x)
    )
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def fenced_code(response: Column) -> Column:
    """Code of a python fence, or the text of an answer tag after a think tag, else the text."""
    fence = r"(?s)```python\s*\n?(.*?)\n?```"
    answer = r"(?s)<answer>(.*?)</answer>"
    return (
        F.when(response.rlike(fence), F.regexp_extract(response, fence, 1))
        .when(
            response.startswith("<think>") & response.rlike(answer),
            F.regexp_extract(response, answer, 1),
        )
        .otherwise(response)
    )


def json_text(response: Column) -> Column:
    """Response without its json fence, newlines and indents, quoted lists unquoted."""
    bare = F.regexp_replace(response, r"(?s)^.*?```json\s*(.*?)\s*```.*$", "$1")
    flat = F.regexp_replace(bare, r"\n|    ", "")
    return F.regexp_replace(F.regexp_replace(flat, r'"\[', "["), r'\]"', "]")


def double_quoted(text: Column) -> Column:
    """A Python-style literal as JSON: single quotes, True, False and None rewritten.

    A text is taken apart into quoted strings and what is between, so quotes,
    words and escapes inside a string stay what they are.
    """
    token = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^'"]+|['"]"""

    def rewritten(t: Column) -> Column:
        inner = F.substring(t, F.lit(2), F.length(t) - 2)
        inner = F.regexp_replace(inner, r"\\'", "'")
        inner = F.regexp_replace(inner, r'(?<!\\)"', r'\\"')
        plain = F.regexp_replace(t, r"\bTrue\b", "true")
        plain = F.regexp_replace(F.regexp_replace(plain, r"\bFalse\b", "false"), r"\bNone\b", "null")
        return (
            F.when(t.rlike(r"(?s)^'.*'$") & (F.length(t) > 1), F.concat(F.lit('"'), inner, F.lit('"')))
            .when(t.startswith('"'), t)
            .otherwise(plain)
        )

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(token), F.lit(0)), rewritten), "")


def lenient_json(response: Column) -> Column:
    """Struct (ok, value, text): the parsed value, or the text where it does not parse."""
    text = json_text(response)
    value = F.coalesce(F.try_parse_json(text), F.try_parse_json(double_quoted(text)))
    return F.struct(
        value.isNotNull().alias("ok"),
        value.alias("value"),
        F.when(value.isNull(), response).alias("text"),
    )


def split_turns(df: DataFrame, column: str) -> DataFrame:
    """One row per turn of a question joined by vertical bars, blanks skipped."""
    turns = F.filter(F.split(F.col(column), r"\|"), lambda t: ~t.isin("", " "))
    return df.select(
        *[c for c in df.columns if c != column], F.posexplode(turns).alias("turn", column)
    )


def trim_to_format(question: Column, answer: Column) -> Column:
    """What follows the question's requested format in the answer, newlines stripped."""
    wanted = F.regexp_replace(F.split_part(question, F.lit("Format: "), F.lit(2)), r"\n+$", "")
    named = (F.instr(question, F.lit("Format: ")) > 0) & (wanted != "")
    kept = F.when(named & answer.contains(wanted), F.split_part(answer, wanted, F.lit(2))).otherwise(answer)
    return F.regexp_replace(kept, r"^\n+|\n+$", "")


def line_body(line: Column) -> Column:
    """Text after the first ": " of a line, null without one."""
    at = F.instr(line, F.lit(": "))
    return F.when(at > 0, F.substr(line, at + 2))


def token_count(text: Column) -> Column:
    """Words and single marks in a text."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))


class PieceCounts(dict):
    """Token counts of pieces, made one by one where they are first met; starts afresh at its bound."""

    def __init__(self, codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> int:
        count = len(self.codec.encode(piece, add_special_tokens=False))
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = count
        return count

    def of(self, text: str) -> int:
        """Tokens of a whole text, block by block."""
        total, at = 0, 0
        while len(text) - at > BLOCK_CHARS:
            end = PIECE.search(text, at + BLOCK_CHARS).end()
            total += sum(map(self.__getitem__, PIECE.findall(text, at, end)))
            at = end
        return total + sum(map(self.__getitem__, PIECE.findall(text, at)))


def bpe_token_count(text: Column, vocabulary: str) -> Column:
    """Tokens of a text under a byte-pair vocabulary, a JSON file of the tokenizers library.

    The driver reads the file, so executors need not hold it. Names of special tokens
    inside a text are ordinary text. Null stays null, an empty text has no tokens.
    The vocabulary's words must start where white space does, as byte-level ones do.
    """
    with open(vocabulary, encoding="utf-8") as file:
        rules = file.read()
    kept: dict = {}

    def pieces() -> PieceCounts:
        # read once a task
        if not kept:
            from tokenizers import Tokenizer

            codec = Tokenizer.from_str(rules)
            codec.encode_special_tokens = True
            codec.no_truncation()
            codec.no_padding()
            kept["pieces"] = PieceCounts(codec)
        return kept["pieces"]

    @F.pandas_udf("int")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            counts = pd.Series([pieces().of(t or "") for t in texts], dtype="Int32")
            yield counts.mask(texts.isna().to_numpy())

    return counted(text)
