"""Readers and writers for tables, metadata, answers and sidecar documents."""

from __future__ import annotations

import csv
import io
import warnings
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.text import markup_lines, text_blocks
from tablewright.operators.describe import MAX_LINES, sidecar_text
from tablewright.operators.licences import MISSING
from tablewright.sources.office import CELLS, read_word_files, read_workbooks, sheet_texts, table_rows

PATH_LEVELS = ("data_source", "dataset_id", "qid")

METADATA = T.StructType([
    T.StructField("dataset_title", T.StringType()),
    T.StructField("dataset_description", T.StringType()),
    T.StructField("publisher", T.StringType()),
    T.StructField("license", T.StringType()),
    T.StructField("landingPage", T.StringType()),
    T.StructField("distribution", T.ArrayType(T.StructType([
        T.StructField("file_name", T.StringType()),
        T.StructField("file_title", T.StringType()),
        T.StructField("file_description", T.StringType()),
    ]))),
    T.StructField("external_knowledge", T.ArrayType(T.StringType())),
    T.StructField("_corrupt", T.StringType()),
])
COLUMN_NOTES = "meta struct<view struct<columns array<struct<name string, description string>>>>"

# Sidecar kinds by file extension; kinds without a reader map to none.
SIDECAR_KINDS = {
    "json": "json", "csv": "csv", "txt": "txt", "xml": "xml", "html": "html",
    "xlsx": "xlsx", "docx": "docx", "xls": None, "pdf": None, "doc": None,
}
# Headers of a workbook that explains the variables of a table.
VARIABLE_HEADERS = {
    "column": "Variable_name/Variable_Nom", "label": "Variable_Label/Étiquette_Variable",
    "description": "Definition/Définition\n", "values": "Values/Valeurs", "invalid_values": "Invalid_values/Valeurs invalides",
}

TEXT_OF = {
    "txt": lambda value: value,
    "xml": markup_lines,
    "html": lambda value: F.array_join(text_blocks(value), "\n"),
}


def badly_encoded(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """Files that do not decode as UTF-8, found in one scan."""
    lines = spark.read.text(list([paths] if isinstance(paths, str) else paths))
    bad = (
        lines.select(F.col("_metadata.file_path").alias("file"), "value")
        .filter(~F.is_valid_utf8("value"))
        .select("file")
        .distinct()
    )
    # the metadata path is URL-encoded, the reader's is not
    return [unquote(r["file"]) for r in bad.collect()]


def read_table(
    spark: SparkSession,
    paths: str | Sequence[str],
    fallback_encoding: str | None = "ISO-8859-1",
    schema: T.StructType | str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """CSV files with a header; files that are not UTF-8 are read in the fallback encoding.

    A file is read in splits unless ``multi_line`` says that cells hold line breaks.
    """
    names = [paths] if isinstance(paths, str) else list(paths)

    def csv(files, encoding, kind):
        reader = spark.read.option("header", True).option("encoding", encoding)
        reader = reader.option("multiLine", multi_line).option("escape", '"')
        return reader.schema(kind).csv(files) if kind is not None else reader.option("inferSchema", True).csv(files)

    bad = badly_encoded(spark, names) if fallback_encoding else []
    if not bad:
        return csv(names, "UTF-8", schema)
    listed = spark.read.format("binaryFile").load(names).select("_metadata.file_path").collect()
    good = sorted({unquote(r["file_path"]) for r in listed} - set(bad))
    if not good:
        return csv(bad, fallback_encoding, schema)
    first = csv(good, "UTF-8", schema)
    return first.unionByName(csv(bad, fallback_encoding, schema or first.schema))


def read_tables(spark: SparkSession, paths: dict[str, str], **options) -> dict[str, DataFrame]:
    """Tables by name; one that cannot be read is skipped with a warning."""
    tables = {}
    for name, path in paths.items():
        try:
            tables[name] = read_table(spark, path, **options)
        except PySparkException as error:
            warnings.warn(f"{name} skipped: {error.getCondition()}", stacklevel=2)
    return tables


def _relative(root: str) -> F.Column:
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.regexp_replace(F.col("_metadata.file_path"), "^[a-z0-9]+:/*", "/")
    return F.replace(path, F.lit(base + "/"), F.lit(""))


def read_metadata(spark: SparkSession, root: str, file_name: str = "metadata.json") -> DataFrame:
    """Every dataset's metadata under ``root``; files that do not parse are left out."""
    found = (
        spark.read.schema(METADATA)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", file_name)
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(root)
        .withColumn("path", F.regexp_replace(_relative(root), "/?[^/]*$", ""))
    )
    license = F.when(F.col("license") != "", F.col("license"))
    return (
        found.filter(F.col("_corrupt").isNull())
        .drop("_corrupt")
        .withColumns({
            "license": F.coalesce(license, F.lit(MISSING)),
            "publisher": F.coalesce("publisher", F.lit("")),
            "dataset_title": F.coalesce("dataset_title", F.lit("")),
            "landingPage": F.coalesce("landingPage", F.lit("")),
        })
    )


def read_keyed_json(
    spark: SparkSession,
    root: str,
    file_name: str,
    schema: T.StructType | str,
    levels: Sequence[str] = PATH_LEVELS,
) -> DataFrame:
    """JSON files at ``{level}/{level}/../{file_name}`` with the levels as columns."""
    found = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", file_name)
        .json(root)
    )
    pieces = F.split(_relative(root), "/")
    keyed = found.select("*", pieces.alias("_pieces")).filter(F.size("_pieces") == len(levels) + 1)
    return keyed.select(
        *[F.get("_pieces", F.lit(i)).alias(n) for i, n in enumerate(levels)], *found.columns
    )


def read_column_notes(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """(column, description) of a JSON column document, for columns of the table.

    A root list or a file without ``meta`` gives nothing, and so does one matched
    column without a description; empty descriptions are skipped.
    """
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.filter(~F.ltrim("value").startswith("[")).select(
        F.explode(F.from_json("value", COLUMN_NOTES)["meta"]["view"]["columns"]).alias("c")
    )
    matched = parsed.select(F.col("c.name").alias("column"), F.col("c.description").alias("description"))
    matched = matched.filter(F.col("column").isin(*columns))
    gap = matched.agg(F.coalesce(F.bool_or(F.col("description").isNull()), F.lit(False))).scalar()
    return matched.filter(~gap & (F.col("description") != ""))


def _whole(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, value) of whole text files; the metadata path is URL-encoded, the reader's is not."""
    return spark.read.text(list(paths), wholetext=True).select(_unescaped(F.col("_metadata.file_path")).alias("path"), "value")


def _unescaped(text: F.Column) -> F.Column:
    """Text with ``%XX`` read as characters and a plus sign as itself."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def keyed_column_notes(spark: SparkSession, paths: Sequence[str], levels: Sequence[str] = ()) -> DataFrame:
    """(path, column, description) of the JSON column documents at ``paths``, whatever their columns, in one scan.

    ``levels`` are folders ``name=value`` of the path to be columns too. Documents that are lists or have no ``meta`` give nothing.
    """
    rows = _whole(spark, paths).filter(~F.ltrim("value").startswith("[")).select(
        "path", F.explode(F.from_json("value", COLUMN_NOTES)["meta"]["view"]["columns"]).alias("c")
    )
    keys = [_unescaped(F.regexp_extract("path", f"/{level}=([^/]*)", 1)).alias(level) for level in levels]
    return rows.select("path", *keys, F.col("c.name").alias("column"), F.col("c.description").alias("description"))


def matched_column_notes(notes: DataFrame, names: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Notes of the columns in ``names`` (keys, column); none of a document with a matched column without a description."""
    matched = notes.join(names.select(*keys, "column").distinct(), [*keys, "column"])
    gaps = matched.where(F.col("description").isNull()).select("path").distinct()
    return matched.where(F.col("description") != "").join(gaps, "path", "left_anti")


def read_variable_notes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, column, label, description, values, invalid_values) of workbooks that explain the variables of a table."""
    names = list(VARIABLE_HEADERS.values())
    rows = table_rows(read_workbooks(spark, list(paths)).where("place = 1"), names)
    named = rows.select("path", *[F.col(f"`{header}`").alias(name) for name, header in VARIABLE_HEADERS.items()])
    return named.where(F.col("column").isNotNull())


def csv_cells(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The cells of small CSV files of any columns, as those of workbooks, in one scan; empty cells are missing."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, value in zip(frame["path"], frame["value"], strict=True):
                cells = [
                    (path, 1, "", row, column, "text", cell)
                    for row, line in enumerate(csv.reader(io.StringIO(value, newline="")), 1) for column, cell in enumerate(line, 1) if cell
                ]
                yield pd.DataFrame(cells, columns=["path", "place", "sheet", "row", "column", "kind", "value"])

    return _whole(spark, paths).mapInPandas(run, CELLS)


def read_sidecar(spark: SparkSession, path: str, columns: Sequence[str] = (), kind: str | None = None) -> DataFrame:
    """(text): the readable text of one sidecar document, of the kind its name says unless given."""
    kind = SIDECAR_KINDS.get(kind or path.rsplit(".", 1)[-1].lower())
    if kind is None:
        raise ValueError(f"no reader for {path}")
    if kind == "csv":
        table = spark.read.option("header", True).option("inferSchema", True).csv(path)
        ordered = table.withColumn("_at", F.monotonically_increasing_id())
        return sidecar_text(ordered, "_at", table.columns)
    if kind == "json":
        notes = read_column_notes(spark, path, columns)
        line = F.concat_ws(": ", "column", "description")
        return notes.agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))
    if kind == "xlsx":
        return sheet_texts(read_workbooks(spark, path), MAX_LINES).select("text")
    if kind == "docx":
        return read_word_files(spark, path).select("text")
    return spark.read.text(path, wholetext=True).select(TEXT_OF[kind](F.col("value")).alias("text"))


def read_sidecars(
    spark: SparkSession, paths: Sequence[str], columns: Sequence[str] = (), kinds: Sequence[str] | None = None
) -> DataFrame:
    """(path, kind, text, status) of sidecar documents.

    All files of a kind are read by one scan, whatever their columns. Kinds without
    a reader, damaged files and tables too long to be listed are reported by their
    status and have no text.
    """
    kinds = [p.rsplit(".", 1)[-1].lower() for p in paths] if kinds is None else list(kinds)
    of_kind: dict[str, list[str]] = {}
    for path, kind in zip(paths, kinds, strict=True):
        of_kind.setdefault(kind, []).append(path)
    status = F.when(F.col("text").isNull(), "too long").otherwise("read").alias("status")
    frames = []
    for kind, files in of_kind.items():
        reader = SIDECAR_KINDS.get(kind)
        if reader in TEXT_OF:
            found = _whole(spark, files).select("path", TEXT_OF[reader](F.col("value")).alias("text"), F.lit("read").alias("status"))
        elif reader == "csv":
            found = sheet_texts(csv_cells(spark, files), MAX_LINES).select("path", "text", status)
        elif reader == "xlsx":
            cells = read_workbooks(spark, files)
            found = sheet_texts(cells, MAX_LINES).select("path", "text", status).unionByName(
                cells.where("row is null").select("path", F.lit(None).cast("string").alias("text"), F.lit("damaged").alias("status"))
            )
        elif reader == "docx":
            found = read_word_files(spark, files).select(
                "path", "text", F.when(F.col("error").isNull(), "read").otherwise("damaged").alias("status")
            )
        elif reader == "json":
            notes = matched_column_notes(keyed_column_notes(spark, files), spark.createDataFrame([(c,) for c in columns], "column string"), [])
            lines = notes.groupBy("path").agg(F.sort_array(F.collect_list(F.concat_ws(": ", "column", "description"))).alias("of"))
            found = _whole(spark, files).select("path").join(lines, "path", "left").select(
                "path", F.coalesce(F.array_join("of", "\n"), F.lit("")).alias("text"), F.lit("read").alias("status")
            )
        else:
            found = spark.createDataFrame([(path, None, "no reader") for path in files], "path string, text string, status string")
        frames.append(found.select("path", F.lit(kind).alias("kind"), "text", "status"))
    return reduce(DataFrame.unionByName, frames)


def read_labelled_profiles(spark: SparkSession, path: str, labels: Sequence[str]) -> DataFrame:
    """Labelled column profiles of one stage."""
    found = spark.read.option("header", True).option("inferSchema", True).option("escape", '"').csv(path)
    return found.filter(F.col("subcategory").isin(*labels))


def write_json(df: DataFrame, path: str) -> None:
    """Write rows as JSON lines, replacing what is there."""
    df.write.mode("overwrite").json(path)
