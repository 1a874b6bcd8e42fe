"""Quality rules judged by host.

Every document is measured by rules of its own words and lines. The failures of
each rule are added up by host. A host's rate is then shrunk: the rates of all
hosts are read as draws from a beta distribution, whose two parameters come from
their mean and from their variance without the part that counting few documents
explains, and a host with ``f`` failures in ``n`` documents gets the posterior
rate ``(f + a) / (n + a + b)``. Small hosts thus lie near the mean, and a host of
three bad documents is not condemned by them alone. A host is rejected if one of
its rates is above ``LIMIT``, and the verdict is joined back to its documents. A
document is kept if it fails no base rule and its host is not rejected.

Measures are taken in one pass and written to the shared folder. Failures are
combined before the shuffle. Hosts with at least one of ``HEAVY`` rows, which are
``HEAVY`` at most, meet their documents by broadcast, all others by shuffle, so
no task gets the documents of a hot host.

A null text is empty: no words, and it fails the base rule on length. A null host
is a host of its own. Repeated rows, and rows with a null or repeated doc_id, are
documents of their own and all come back. Hosts with equal rates get equal
verdicts. An empty table gives no rows. Columns other than those named are not
read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import in_slices, map_exactly, text_or_empty
from tablewright.session import durable

#: Shrunk rate of failures above which a host is rejected.
LIMIT = 0.5
#: A host with this part of the rows is joined by broadcast.
HEAVY = 256
WINDOW = 3
BLANK = b" \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: A document fails a base rule by itself.
BASE = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
}
#: Rules whose failures are added up by host: the base rules and weaker signs.
RULES = BASE | {
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 3 * n_words or word_chars > 10 * n_words",
}


def repeated(tokens: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    if len(tokens) <= width:
        return 0
    names: dict[bytes, int] = {}
    place = np.fromiter((names.setdefault(t, len(names)) for t in tokens), dtype=np.int64, count=len(tokens))
    key = place
    for step in range(1, width):
        key = key[:-1] * len(names) + place[step:]
        # numbers below the count of windows, so that the next product fits
        _, key, met = np.unique(key, return_inverse=True, return_counts=True)
    again = met[key] > 1
    covered = np.zeros(len(tokens), dtype=bool)
    for step in range(width):
        covered[step : step + len(again)] |= again
    return int(covered.sum())


def measured(text: str) -> tuple[int, ...]:
    """The measures of a whole text, in the order of ``MEASURES``."""
    raw = text.encode("utf-8", "surrogatepass")
    tokens = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip(BLANK)]
    blanks = len(raw) - len(raw.translate(None, BLANK))
    return (
        len(tokens), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines),
        len(lines) - len(set(lines)), repeated(tokens),
    )


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, measures) of every document."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_slices(frames):
            made = np.array([measured(t) for t in frame["text"]], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "host": frame["host"]} | dict(zip(MEASURES, made.T, strict=True)))

    kinds = dict(docs.dtypes)
    fields = ", ".join(f"{m} long" for m in MEASURES)
    sent = docs.select("doc_id", F.col(f"`{host}`").alias("host"), text_or_empty().alias("text"))
    return map_exactly(sent, run, f"doc_id {kinds['doc_id']}, host {kinds[host]}, {fields}")


def host_rates(marked: DataFrame, rules: Mapping[str, str] = RULES) -> DataFrame:
    """(host, rows, rule, failed, rate, shrunk): the rates of every host, raw and shrunk by the beta prior."""
    counted = marked.groupBy("host").agg(
        F.count("*").alias("rows"), *[F.count_if(F.expr(r)).alias(f"failed_{k}") for k, r in rules.items()]
    )
    rates = counted.select("host", "rows", F.explode(F.array(*[
        F.struct(F.lit(k).alias("rule"), F.col(f"failed_{k}").alias("failed")) for k in rules
    ])).alias("of")).select("host", "rows", "of.rule", "of.failed", (F.col("of.failed") / F.col("rows")).alias("rate"))
    seen = rates.groupBy("rule").agg(
        F.avg("rate").alias("mean"), F.var_pop("rate").alias("spread"), F.avg(1 / F.col("rows")).alias("part")
    )
    # the variance between hosts, and the weight of the prior in documents
    between = F.col("spread") - F.col("mean") * (1 - F.col("mean")) * F.col("part")
    prior = seen.select("rule", "mean", F.when(between > 0, F.col("mean") * (1 - F.col("mean")) / between - 1).alias("weight"))
    # one row a rule
    return rates.join(F.broadcast(prior), "rule").select(
        "host", "rows", "rule", "failed", "rate",
        F.when(F.col("weight").isNull(), F.col("mean"))
        .otherwise((F.col("failed") + F.col("mean") * F.col("weight")) / (F.col("rows") + F.col("weight"))).alias("shrunk"),
    )


def host_verdicts(marked: DataFrame, rules: Mapping[str, str] = RULES, limit: float = LIMIT) -> DataFrame:
    """(host, rows, rejected) of every host."""
    return host_rates(marked, rules).groupBy("host", "rows").agg(F.bool_or(F.col("shrunk") > limit).alias("rejected"))


def with_verdicts(marked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``marked`` with ``rejected`` of its host; hot hosts by broadcast."""
    verdicts = durable(verdicts)
    all_rows = verdicts.agg(F.sum("rows")).first()[0] or 0
    told = verdicts.select(F.col("host").alias("of"), "rows", "rejected")
    # hosts with so many rows are HEAVY at most
    heavy = F.broadcast(told.where(F.col("rows") * HEAVY >= all_rows).drop("rows"))
    light = told.where(F.col("rows") * HEAVY < all_rows).drop("rows")
    own = marked["host"].eqNullSafe(F.col("of"))
    return marked.join(heavy, own).drop("of").unionByName(
        marked.join(heavy, own, "left_anti").join(light, own).drop("of")
    )


def judged(
    docs: DataFrame, host: str = "source", base: Mapping[str, str] = BASE, rules: Mapping[str, str] = RULES,
    limit: float = LIMIT,
) -> DataFrame:
    """(doc_id, host, measures, base_failed, host_rejected, kept) of every document."""
    marked = durable(measures(docs, host))
    failed: Column = functools.reduce(lambda a, b: a | b, [F.expr(r) for r in base.values()], F.lit(False))
    told = with_verdicts(marked, host_verdicts(marked, rules, limit))
    return told.withColumn("base_failed", failed).select(
        "doc_id", "host", *MEASURES, "base_failed", F.col("rejected").alias("host_rejected"),
        (~F.col("base_failed") & ~F.col("rejected")).alias("kept"),
    )
