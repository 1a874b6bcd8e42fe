"""The queries of the training-data operators, one for each, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.statements import FAIR_MIX, HOST_RULES, REMOVAL_RANKS, REPEATED_PASSAGES, SPELLING_VARIANTS
from tablewright.plans.registry import table


def op1_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablewright.llm.simhash import hexadecimal, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", hexadecimal().alias("fingerprint"), "component_id"
    )


def op2_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablewright.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablewright.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op4_hashed_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablewright.llm.language import fit, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def op5_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablewright.llm.suffix_dedup import removed

    return removed(table(spark, sf_dir, "documents"))


def op6_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablewright.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op7_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tablewright.llm.bpe import encode

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def op8_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablewright.llm.pii import detect, fit

    docs = table(spark, sf_dir, "documents")
    return detect(docs, fit(docs))


def op9_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablewright.llm.sharding import shards

    return shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablewright.llm.multiset_fingerprint import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablewright.llm.host_rules import judged

    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op12_removal_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablewright.llm.filter_audit import audit, class_counts

    return audit(class_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_pivotal_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablewright.llm.pivotal_grams import variants

    return variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_gray_simhash, op2_fair_mix, op3_tag_path_text, op4_hashed_language,
    op5_suffix_family, op6_posting_lists, op7_backtracking_bpe, op8_boosted_pii,
    op9_histogram_shards, op10_multiset_fingerprint, op11_host_rules, op12_removal_ranks,
    op13_pivotal_grams,
)}

SQL: dict[str, str] = {
    "op2_fair_mix": FAIR_MIX, "op5_suffix_family": REPEATED_PASSAGES, "op11_host_rules": HOST_RULES,
    "op12_removal_ranks": REMOVAL_RANKS, "op13_pivotal_grams": SPELLING_VARIANTS,
}
