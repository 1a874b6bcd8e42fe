"""Lineage of findings: questions, insights and the references between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFERENCE = r"[QI]_\d+_\d+"


def parse_refs(col: Column) -> Column:
    """Node ids in a list text or comma-separated text, in order."""
    return F.regexp_extract_all(col.cast("string"), F.lit(REFERENCE), F.lit(0))


def question_id(iteration: Column, index: Column) -> Column:
    return F.concat_ws("_", F.lit("Q"), iteration.cast("string"), index.cast("string"))


def insight_id(iteration: Column, index: Column) -> Column:
    return F.concat_ws("_", F.lit("I"), iteration.cast("string"), index.cast("string"))


def lineage_edges(qa: DataFrame, insights: DataFrame, graph: Sequence[str] = ()) -> DataFrame:
    """(graph.., source, target): undirected edges, each once, smaller id first.

    ``qa`` holds ``id`` and ``refs`` (insights a follow-up builds on, may be null);
    ``insights`` holds ``id`` and ``refs`` (questions it comes from).
    """
    graph = list(graph)
    pairs = qa.select(*graph, "id", "refs").unionByName(insights.select(*graph, "id", "refs"))
    ends = pairs.select(*graph, "id", F.explode("refs").alias("ref"))
    return ends.select(
        *graph, F.least("id", "ref").alias("source"), F.greatest("id", "ref").alias("target")
    ).distinct()


def lineage_nodes(qa: DataFrame, insights: DataFrame, graph: Sequence[str] = ()) -> DataFrame:
    """(graph.., id, type, question, answer, insight); a node only referred to is bare."""
    graph = list(graph)
    none = F.lit(None).cast("string")
    declared = qa.select(
        *graph, "id", F.lit("QA").alias("type"), "question", "answer", none.alias("insight")
    ).unionByName(
        insights.select(
            *graph, "id", F.lit("insight").alias("type"), none.alias("question"), none.alias("answer"), "insight"
        )
    )
    referred = qa.select(*graph, F.explode("refs").alias("id")).unionByName(
        insights.select(*graph, F.explode("refs").alias("id"))
    )
    bare = referred.select(
        *graph, "id", *[none.alias(c) for c in ("type", "question", "answer", "insight")]
    )
    # One whole row per id: a declared one before bare mentions, the largest of several.
    parts = ("type", "question", "answer", "insight")
    whole = F.max(F.struct(F.col("type").isNotNull().alias("declared"), *parts)).alias("w")
    return declared.unionByName(bare).groupBy(*graph, "id").agg(whole).select(
        *graph, "id", *[F.col(f"w.{c}").alias(c) for c in parts]
    )


def write_lineage(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write both parts of the graph as JSON lines."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/links")


def read_lineage(spark, path: str, graph: str = "") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a written graph; ``graph`` is the DDL of its key columns, with a comma after each."""
    nodes = spark.read.schema(f"{graph} id string, type string, question string, answer string, insight string")
    edges = spark.read.schema(f"{graph} source string, target string")
    return nodes.json(f"{path}/nodes"), edges.json(f"{path}/links")
