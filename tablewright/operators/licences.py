"""Licence audit of a corpus of datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.ranking import small_or_shuffled

MISSING = "<MISSING>"

# Category of known licence strings.
KNOWN_LICENCES = {
    "us-pd": "ok",
    "Creative Commons CCZero": "ok",
    "Other (Public Domain)": "ok",
    "Open Data Commons Public Domain Dedication and License (PDDL)": "ok",
    "Creative Commons Attribution": "attribution",
    "Creative Commons Attribution 4.0": "attribution",
    "Creative Commons Attribution 4.0 International": "attribution",
    "Creative Commons 4.0 Attribution (CC-BY) licence – Quebec": "attribution",
    "Open Government Licence - Canada": "attribution",
    "Open Government Licence - Alberta": "attribution",
    "Open Government Licence – Nova Scotia": "attribution",
    "UK Open Government Licence (OGL)": "attribution",
    "Open Government Licence – Ontario": "attribution",
    "Open Government Licence - British Columbia": "attribution",
    "Open Government License - City of Surrey": "attribution",
    "open-government-licence-toronto": "attribution",
    "Open Data Commons Attribution License": "attribution",
    "ocd-by": "attribution",
    "Creative Commons Attribution Share-Alike": "sharealike",
    "CC-BY-NC-SA-4.0": "noncommercial",
    "License not specified": "problem",
    "other-license-specified": "review",
}
CATEGORIES = ("ok", "attribution", "sharealike", "noncommercial", "review", "problem")
REVOCABLE_PREFIX = "CalHHS Terms of Use"

NOTICES = {
    "noncommercial": "Commercial use is prohibited; share under a compatible noncommercial share-alike licence.",
    "sharealike": "Share under a compatible share-alike licence.",
    "problem": "Non-standard licence; see the source of each dataset.",
}
REVOCABLE_NOTICE = "Revocable licence; attribution, source link and publication date are required."
CORPUS_NOTICE = "The corpus as a whole is limited to noncommercial use."


def license_category(col: Column) -> Column:
    """Category of a licence text; the first rule that holds decides."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN_LICENCES.items() for x in pair])
    return (
        F.when(col.isNull() | col.isin("", MISSING), "problem")
        .otherwise(
            F.coalesce(
                F.try_element_at(known, col),
                F.when(col.contains("NC"), "noncommercial")
                .when(col.rlike("Share-Alike|ShareAlike|-SA"), "sharealike")
                .when(col.startswith(REVOCABLE_PREFIX), "attribution")
                .otherwise("review"),
            )
        )
    )


def _named(df: DataFrame, license: str) -> DataFrame:
    text = F.col(license)
    return df.withColumn(license, F.when(text.isNull() | (text == ""), MISSING).otherwise(text))


def by_license(df: DataFrame, license: str = "license") -> DataFrame:
    """(license, category, datasets): most used first."""
    counts = _named(df, license).groupBy(license).agg(F.count(F.lit(1)).alias("datasets"))
    return counts.withColumn("category", license_category(F.col(license))).orderBy(
        F.col("datasets").desc(), license
    )


def license_items(df: DataFrame, item: str, license: str = "license") -> DataFrame:
    """Every dataset under its licence, as rows in report order.

    Rows instead of one list per licence: a licence may cover most of a corpus.
    """
    counts = by_license(df, license)
    return _named(df, license).join(small_or_shuffled(counts), license).orderBy(
        F.col("datasets").desc(), license, item
    )


def by_category(df: DataFrame, license: str = "license") -> DataFrame:
    """(category, datasets, total) for all six categories, also the empty ones."""
    counts = df.groupBy(license_category(F.col(license)).alias("category")).agg(
        F.count(F.lit(1)).alias("datasets")
    )
    aggs = [
        F.coalesce(F.sum(F.when(F.col("category") == c, F.col("datasets"))), F.lit(0)).alias(c)
        for c in CATEGORIES
    ]
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("datasets")) for c in CATEGORIES])
    totals = counts.agg(*aggs, F.coalesce(F.sum("datasets"), F.lit(0)).alias("total"))
    return totals.select("total", F.inline(rows))


def problem_count(df: DataFrame, license: str = "license") -> DataFrame:
    """One row: datasets with a problem licence, and whether a strict check fails."""
    problem = license_category(F.col(license)) == "problem"
    return df.agg(F.count_if(problem).alias("problems")).withColumn("failed", F.col("problems") > 0)


def license_notices(df: DataFrame, license: str = "license") -> DataFrame:
    """Notice per licence, and the corpus-wide one when anything is noncommercial."""
    groups = by_license(df, license)
    notice = F.try_element_at(
        F.create_map(*[F.lit(x) for pair in NOTICES.items() for x in pair]), F.col("category")
    )
    revocable = F.when(F.col(license).startswith(REVOCABLE_PREFIX), REVOCABLE_NOTICE)
    any_nc = df.agg(F.bool_or(license_category(F.col(license)) == "noncommercial")).scalar()
    return groups.select(
        license,
        "category",
        "datasets",
        F.concat_ws(" ", notice, revocable).alias("notice"),
        F.when(any_nc, CORPUS_NOTICE).otherwise("").alias("corpus_notice"),
    )
