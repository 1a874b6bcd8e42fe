"""Scores of predicted answers and insights against gold ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Votes needed, and the verdict that counts.
VOTES_NEEDED = 3
SAME = "Same"


def match_turns(pred: DataFrame, gold: DataFrame, keys: Sequence[str], pred_col: str = "pred", gold_col: str = "target") -> DataFrame:
    """Gold turns with their prediction and whether the two are equal."""
    joined = gold.join(pred.select(*keys, pred_col), list(keys), "left")
    return joined.withColumn("match", F.col(pred_col).eqNullSafe(F.col(gold_col)))


def qa_accuracy(matches: DataFrame, question: Sequence[str]) -> DataFrame:
    """One row: turns, questions, share of turns right, share of questions all right."""
    per_question = matches.groupBy(*question).agg(
        F.count(F.lit(1)).alias("turns"),
        F.count_if("match").alias("right"),
    )
    return per_question.agg(
        F.sum("turns").alias("turns"),
        F.count(F.lit(1)).alias("questions"),
        (F.sum("right") / F.sum("turns")).alias("single_accuracy"),
        F.avg((F.col("right") == F.col("turns")).cast("double")).alias("multi_accuracy"),
    )


def best_match(
    scores: DataFrame, keys: Sequence[str] = (), gold: str = "gt_id", pred: str = "pred_id", score: str = "score",
    items: DataFrame | None = None,
) -> DataFrame:
    """Best scored prediction of every gold item; the smallest id among ties.

    Takes judged pairs as rows. Gold items of ``items`` (keys, gold) without a pair
    have no prediction and score 0. The best so far is kept on the map side, so an
    item with very many pairs costs no more than its share of the scan.
    """
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(pred)).alias("p"))).alias("b")
    found = scores.groupBy(*keys, gold).agg(best).select(
        *keys, gold, (-F.col("b.p")).alias(pred), F.col("b.s").alias(score)
    )
    if items is None:
        return found
    every = items.select(*keys, gold).distinct().join(found, [*keys, gold], "left")
    return every.select(*keys, gold, pred, F.coalesce(score, F.lit(0.0)).alias(score))


def fallback_index(gold: Column, size: Column) -> Column:
    """A repeatable choice of 1..size for a gold item without a partner."""
    digest = F.conv(F.substring(F.md5(gold.cast("string")), 1, 8), 16, 10).cast("bigint")
    return (digest % size + 1).cast("int")


def score_matching(
    gold: DataFrame,
    pred: DataFrame,
    matching: DataFrame,
    pair_score,
    keys: Sequence[str],
    unmatched: str = "hash",
) -> DataFrame:
    """Scores of a given matching.

    ``gold`` holds keys, ``gt_id`` and ``gt_text``; ``pred`` keys, ``pred_index``
    (from 1) and ``pred_text``; ``matching`` keys, ``gt_id`` and ``pred_index``,
    -1 for none. An unmatched item takes a prediction by hash, or scores 0. Every
    gold item has a row: one that the matching leaves out is unmatched, and one
    whose dataset has no prediction scores 0.
    """
    keys = list(keys)
    sizes = pred.groupBy(*keys).agg(F.max("pred_index").alias("_size"))
    chosen = gold.join(matching, [*keys, "gt_id"], "left").join(sizes, keys, "left")
    index = F.when(F.col("pred_index") > 0, F.col("pred_index"))
    if unmatched == "hash":
        index = F.coalesce(index, fallback_index(F.col("gt_id"), F.col("_size")))
    chosen = chosen.withColumn("pred_index", index).drop("_size")
    paired = chosen.join(pred, [*keys, "pred_index"], "left")
    value = F.coalesce(pair_score(F.col("gt_text"), F.col("pred_text")), F.lit(0.0))
    return paired.withColumn("score", value)


def expected_rating(tokens: DataFrame, group: Sequence[str], token: str = "token", logprob: str = "logprob") -> DataFrame:
    """Probability-weighted rating over the top tokens of each answer."""
    rating = F.when(F.col(token).rlike(r"^\d+$"), F.col(token).try_cast("double")).otherwise(0.0)
    p = F.exp(F.col(logprob))
    return tokens.groupBy(*group).agg((F.sum(rating * p) / F.sum(p)).alias("rating"))


def parse_rating(text: Column) -> Column:
    """Number in a rating tag, else the text or its first line as a number, else null."""
    tag = r"<rating>(\d+)</rating>"
    first = F.trim(F.split_part(text, F.lit("\n"), F.lit(1)))
    number = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    return (
        F.when(text.rlike(tag), F.regexp_extract(text, tag, 1).try_cast("double"))
        .when(F.trim(text).rlike(number), F.trim(text).try_cast("double"))
        .when(first.rlike(number), first.try_cast("double"))
    )


def majority(votes: DataFrame, key: Sequence[str], verdict: str = "verdict", at_least: int = VOTES_NEEDED) -> DataFrame:
    """Whether enough judges say the two are the same; malformed verdicts do not count."""
    return votes.groupBy(*key).agg(
        F.count_if(F.coalesce(F.col(verdict) == SAME, F.lit(False))).alias("same")
    ).withColumn("match", F.col("same") >= at_least)


def dataset_scores(best: DataFrame, summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean best score and summary score of every dataset; pairs stay rows of ``best``.

    A dataset of ``summaries`` without any pair scores 0 over 0 pairs.
    """
    insight = best.groupBy(*keys).agg(
        F.avg("score").alias("insight_score"), F.count(F.lit(1)).alias("pairs")
    )
    joined = insight.join(summaries, list(keys), "full")
    return joined.withColumns({
        "insight_score": F.coalesce("insight_score", F.lit(0.0)), "pairs": F.coalesce("pairs", F.lit(0).cast("bigint")),
    })


def token_set(text: Column) -> Column:
    return F.array_distinct(
        F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    )


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens of a pair of texts; 0 when both are empty."""
    left, right = token_set(a), token_set(b)
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def similar_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], at_least: float, left_id: str = "gt_id", right_id: str = "pred_id",
    text: str = "text",
) -> DataFrame:
    """(keys, left_id, right_id, score): pairs of one dataset whose token Jaccard reaches ``at_least`` (above 0).

    Tokens are ordered from rare to frequent over both sides. A pair that reaches
    the score shares one of the first ``n - ceil(at_least * n) + 1`` tokens of
    either text, so only those are joined, on (keys, token); nothing is capped.
    """
    keys = list(keys)

    def tokens(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.col(name), token_set(F.col(text)).alias("_set"))

    sides = {left_id: tokens(left, left_id), right_id: tokens(right, right_id)}
    each = [s.select(*keys, F.explode("_set").alias("_t")) for s in sides.values()]
    often = each[0].unionByName(each[1]).groupBy(*keys, "_t").agg(F.count(F.lit(1)).alias("_n"))
    heads = []
    for name, side in sides.items():
        ranked = (
            side.select(*keys, name, F.size("_set").alias("_size"), F.explode("_set").alias("_t"))
            .join(often, [*keys, "_t"])
            .groupBy(*keys, name)
            .agg(F.max("_size").alias("_size"), F.sort_array(F.collect_list(F.struct("_n", "_t"))).alias("_by"))
        )
        kept = (F.col("_size") - F.ceil(F.lit(float(at_least)) * F.col("_size") - 1e-9) + 1).cast("int")
        heads.append(ranked.select(*keys, name, F.explode(F.slice("_by", 1, kept)).alias("_h")).select(*keys, name, "_h._t"))
    pairs = heads[0].join(heads[1], [*keys, "_t"]).select(*keys, left_id, right_id).distinct()
    a, b = (s.withColumnRenamed("_set", f"_{n}") for n, s in sides.items())
    both = pairs.join(a, [*keys, left_id]).join(b, [*keys, right_id])
    shared = F.size(F.array_intersect(f"_{left_id}", f"_{right_id}"))
    score = shared / (F.size(f"_{left_id}") + F.size(f"_{right_id}") - shared)
    return both.select(*keys, left_id, right_id, score.alias("score")).filter(F.col("score") >= at_least - 1e-12)
