"""Grouping of spelling variants by pivotal grams.

Words are near if one code point inserted, deleted or replaced turns one into the
other. All bigrams are ordered by the number of words that hold them, rarest
first. A word's *prefix* is its ``GRAM * EDITS + 1`` first bigrams in that order,
with any that tie with the last. Its *pivots* are ``EDITS + 1`` of these that do
not overlap and are the rarest together, found by dynamic programming. One edit
spoils at most one of two bigrams that do not overlap, so of two near words, the
one whose prefix ends first has a pivot that is also in the prefix of the other.

Pivots are therefore looked up in the prefixes of all words, within the limits
that positions set: the edit lies after the pivot, and the words agree up to it,
or before, and they agree from it on; their lengths differ by one at most. Pairs
that meet are verified inside the join, first by the sets of their letters, of
which one edit changes two at most, and only near pairs leave it.

Words are counted in each task before the shuffle, and no document or word list
passes through the driver; it holds the counts of bigrams, which are at most
``LETTERS`` squared. A word has at most two or three near words a letter and
position, so no group is large. Roots are found by doubling the step along the
forms: each form is at least twice as frequent, so paths are short.

A null text has no words. A null doc_id is written as the empty string. Repeated
rows are counted as often as they come. Among near words with equal counts the
first in code-point order is the form. An empty table, or one without words,
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import in_slices, map_exactly, text_or_empty
from tablewright.session import durable

#: Letters after lower-casing: a to z and U+00C0 to U+00FF.
LETTER = "[a-zÀ-ÿ]"
LETTERS = 26 + 64
GRAM, EDITS = 2, 1
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form is at least so many times as frequent.
TIMES = 2
DAMAGE = 97
#: Distinct words that a task holds before it sends them on.
HELD = 200_000


def damaged(start: int, run: str) -> str:
    """The run without one code point if the checksum of document and run says so; ``start`` is that of the document."""
    value = zlib.crc32(run.encode(), start)
    if value % DAMAGE:
        return run
    at = value % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, length: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least ``length`` code points met at least ``least`` times."""
    # damage never makes a run longer
    runs = re.compile(f"{LETTER}{{{length},}}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for frame in in_slices(frames):
            for name, text in zip(frame["doc_id"], frame["text"], strict=True):
                start = zlib.crc32(f"{name}:".encode())
                lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                for found, times in Counter(runs.findall(lowered)).items():
                    word = damaged(start, found)
                    if len(word) >= length:
                        held[word] += times
            if len(held) >= HELD:
                yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                held.clear()
        yield pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})

    sent = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), text_or_empty().alias("text"))
    counted = sent.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least)


def grams(word: str, size: int = GRAM) -> list[str]:
    return [word[i : i + size] for i in range(len(word) - size + 1)]


def gram_counts(found: DataFrame) -> dict[str, int]:
    """Words that hold each bigram; as many entries as there are pairs of letters at most."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for frame in frames:
            for word in frame["word"]:
                held.update(set(grams(word)))
        yield pd.DataFrame({"gram": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})

    total = found.select("word").mapInPandas(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in total.collect()}


def prefix(word: str, counts: Mapping[str, int], size: int = GRAM, edits: int = EDITS) -> tuple[list[int], list[int]]:
    """(positions of the prefix, positions of its first ``size * edits + 1`` bigrams), each from left to right."""
    own = grams(word, size)
    order = sorted(range(len(own)), key=lambda i: (counts[own[i]], own[i], i))
    first = order[: size * edits + 1]
    if not first:
        return [], []
    last = own[first[-1]]
    return sorted(i for i in order if i in first or own[i] == last), sorted(first)


def pivots(word: str, first: list[int], counts: Mapping[str, int], size: int = GRAM, edits: int = EDITS) -> list[int]:
    """Positions of the ``edits + 1`` bigrams among ``first`` that do not overlap and have the least total count.

    Best sums by dynamic programming: for each number of bigrams taken, and each
    position that is taken last.
    """
    weight = [counts[word[i : i + size]] for i in first]
    best: list[list[tuple[int, list[int]] | None]] = [[(w, [i]) for w, i in zip(weight, first, strict=True)]]
    for _ in range(edits):
        row: list[tuple[int, list[int]] | None] = []
        for k, i in enumerate(first):
            before = [b for b, j in zip(best[-1][:k], first, strict=False) if b is not None and i - j >= size]
            least = min(before, default=None)
            row.append(None if least is None else (least[0] + weight[k], [*least[1], i]))
        best.append(row)
    chosen = min((b for b in best[-1] if b is not None), default=None)
    if chosen is None:
        raise ValueError(f"{word!r} has no {edits + 1} bigrams apart: words need {size * (edits + 1)} code points")
    return chosen[1]


def letter_bits(word: str) -> int:
    """The letters of a word as bits, several letters to one."""
    return sum({1 << ord(c) % 61 for c in word})


def _entries(found: DataFrame, counts: Mapping[str, int], probing: bool) -> DataFrame:
    """(side, part, length, word, letters): prefixes as they are, or pivots with the lengths and sides of near words."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_slices(frames, 4_096):
            rows = []
            for word in frame["word"]:
                every, first = prefix(word, counts)
                lengths, letters = (len(word),), letter_bits(word)
                if probing:
                    every = pivots(word, first, counts)
                    lengths = tuple(range(len(word) - EDITS, len(word) + EDITS + 1))
                for at in every:
                    for side, part in (("<", word[: at + GRAM]), (">", word[at:])):
                        rows += [(side, part, length, word, letters) for length in lengths]
            yield pd.DataFrame(rows, columns=["side", "part", "length", "word", "letters"])

    return found.select("word").mapInPandas(run, "side string, part string, length int, word string, letters long")


def near_pairs(found: DataFrame) -> DataFrame:
    """(a, b), a before b: all pairs of words (column word) that one edit turns into each other."""
    counts = gram_counts(found)
    probe = _entries(found, counts, True).withColumnsRenamed({"word": "a", "letters": "letters_a"})
    index = _entries(found, counts, False).withColumnsRenamed({"word": "b", "letters": "letters_b"})
    met = probe.join(index, ["side", "part", "length"]).where(
        (F.bit_count(F.col("letters_a").bitwiseXOR(F.col("letters_b"))) <= 2 * EDITS)
        & (F.col("a") != F.col("b")) & (F.levenshtein("a", "b", EDITS) == EDITS)
    )
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the end of each path of forms.

    Every round joins each open word with the word it points to, which doubles
    the step, and closes those that point to an end.
    """
    steps = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = durable(steps.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")
        ))
        steps = moved.select("word", "root")
        if moved.where("open").isEmpty():
            return steps


def grouped(found: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n)."""
    found = durable(found.select("word", "n"))
    pairs = durable(near_pairs(found))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(found.select(F.col("word").alias("b"), "n"), "b").groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("least"), F.col("b").alias("form"))).alias("best")
    )
    named = found.join(near, "word", "left").withColumn("best_n", -F.col("best.least"))
    fits = F.col("best_n") >= times * F.col("n")
    formed = durable(named.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best.form")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n"),
    ))
    ends = roots(formed.where(F.col("form").isNotNull()))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def variants(docs: DataFrame, length: int = LEAST_LENGTH, least: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs``."""
    return grouped(words(docs, length, least), times)
