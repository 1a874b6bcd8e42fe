"""Expressions over the array of sample values of one column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.dates import reads_as_date

# Text patterns, anchored at the start only.
DELIMITED = r"^[^,;:|]+[,;:|][^,;:|]+"
URL = r"^(http|ftp|https)://[\w-]+(\.[\w-]+)+"
EMAIL = r"^\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,6}\b"
PLAIN_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
SIGNED_NUMBER = r"-?[0-9]+\.?[0-9]*"

# Common English function words.
STOP_WORDS = (
    "a", "about", "after", "again", "all", "am", "an", "and", "any", "are", "as", "at",
    "be", "because", "been", "before", "being", "below", "between", "both", "but", "by",
    "can", "did", "do", "does", "doing", "down", "during", "each", "few", "for", "from",
    "further", "had", "has", "have", "having", "he", "her", "here", "hers", "him", "his",
    "how", "i", "if", "in", "into", "is", "it", "its", "just", "me", "more", "most", "my",
    "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our",
    "out", "over", "own", "same", "she", "should", "so", "some", "such", "than", "that",
    "the", "their", "them", "then", "there", "these", "they", "this", "those", "through",
    "to", "too", "under", "until", "up", "very", "was", "we", "were", "what", "when",
    "where", "which", "while", "who", "whom", "why", "will", "with", "you", "your",
)


def per_sample(samples: str, measure: Callable[[Column], Column]) -> Column:
    """Array of one measure per sample, as doubles."""
    return F.transform(F.col(samples), lambda s: measure(s).cast("double"))


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def count_matching(samples: str, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(F.col(samples), lambda s: F.coalesce(test(s), F.lit(False))))


def stop_word_count(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z]+"), F.lit(0))
    return F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS)))


MEASURES = {
    "word_count": lambda s: F.size(F.split(s, " ")),
    "stopword_total": stop_word_count,
    "char_count": lambda s: F.length(s),
    "whitespace_count": lambda s: F.regexp_count(s, F.lit(" ")),
    "delim_count": lambda s: F.regexp_count(s, F.lit("[,;:|]")),
}


def with_shape(samples: DataFrame) -> DataFrame:
    """Add the sample-derived part of a profile to a frame with ``samples``.

    The few samples are unfolded to rows, so every measure is a plain expression.
    """
    text = F.col("_sample")
    aggs = []
    for name, measure in MEASURES.items():
        value = measure(text).cast("double")
        aggs += [F.avg(value).alias(f"mean_{name}"), F.stddev_pop(value).alias(f"std_dev_{name}")]
    tests = {
        "has_delimiters": text.rlike(DELIMITED),
        "has_url": text.rlike(URL),
        "has_email": text.rlike(EMAIL),
        "has_date": F.col("has_values")
        & ((F.col("dtype") == "datetime") | (F.col("dtype") == "string") & reads_as_date(text)),
    }
    # More than half of the five samples must match.
    aggs += [(F.count_if(F.coalesce(t, F.lit(False))) > 2).alias(n) for n, t in tests.items()]
    return (
        samples.withColumn("_sample", F.explode("samples"))
        .groupBy(*samples.columns)
        .agg(*aggs)
        .withColumns(
            {
                "is_list": F.col("has_delimiters") & (F.col("mean_char_count") < 100),
                "is_long_sentence": F.col("mean_word_count") > 10,
            }
        )
    )


def digit_columns() -> list[Column]:
    digits = per_sample("samples", lambda s: F.regexp_count(s, F.lit("[0-9]")))
    tokens = per_sample("samples", lambda s: F.regexp_count(s, F.lit(SIGNED_NUMBER)))
    return [
        array_mean(digits).alias("num_number_characters"),
        array_mean(tokens).alias("num_separated_tokens"),
        count_matching("samples", lambda s: s.contains(",")).alias("comma_include"),
    ]
