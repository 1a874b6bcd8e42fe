"""Workbooks and word-processor files as Spark data sources.

``workbook`` reads cells of .xlsx files, one row each, whatever their columns,
and writes rows as .xlsx files. ``wordfile`` reads the paragraphs of .docx files
as one text a file, and writes (name, text) rows as such files. Files are packed
into input partitions by size and read inside the tasks, through the file
systems that Arrow knows; the driver sees their names and sizes only. XML is read
as a stream, so a task holds one table of shared strings and one batch of cells.

A file that cannot be read gives one row of kind ``error`` (a workbook) or a null
text with its reason. Control characters that XML does not allow are ``_xHHHH_`` in
a workbook and U+FFFD in a word-processor file. A missing cell has no row; an empty sheet or file gives none.
"""

from __future__ import annotations

import datetime
import json
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

CELLS = "path string, place int, sheet string, row int, column int, kind string, value string"
TEXTS = "path string, text string, error string"
#: Bytes of files for one input partition, and what opening a file counts as.
PACKED, OPENING = 64 << 20, 1 << 20
#: Cells of one batch, and rows of one written workbook (a sheet holds 1,048,576).
BATCH, SHEET_ROWS = 8_192, 100_000

# Names and numbers of the office file formats.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
EPOCH, EPOCH_1904 = datetime.datetime(1899, 12, 30), datetime.datetime(1904, 1, 1)
TYPES = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/>{}</Types>'
)
PART = '<Override PartName="/{}" ContentType="application/vnd.openxmlformats-officedocument.{}+xml"/>'
RELATIONS = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    "{}</Relationships>"
)
RELATED = '<Relationship Id="rId{}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/>'

_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]"
_FORBIDDEN = re.compile(_CONTROL + "|_(?=x[0-9A-Fa-f]{4}_)")
_ENCODED = re.compile("_x([0-9A-Fa-f]{4})_")
_QUOTED = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]')


def encoded(text: str) -> str:
    return escape(_FORBIDDEN.sub(lambda m: f"_x{ord(m[0]):04X}_", text).replace("\r", "_x000D_"))


def decoded(text: str) -> str:
    return _ENCODED.sub(lambda m: chr(int(m[1], 16)), text)


def column_number(reference: str) -> int:
    """Place of a cell reference's column, from 1: A is 1, AA is 27."""
    place = 0
    for c in reference:
        if not c.isalpha():
            break
        place = place * 26 + ord(c.upper()) - 64
    return place


def column_letters(place: int) -> str:
    letters = ""
    while place:
        place, rest = divmod(place - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


def elements(package: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """The closed elements of one tag in a part, each forgotten after its use."""
    with package.open(name) as part:
        path: list[ElementTree.Element] = []
        for event, element in ElementTree.iterparse(part, ("start", "end")):
            if event == "start":
                path.append(element)
                continue
            path.pop()
            if element.tag == tag:
                yield element
                if path:
                    path[-1].remove(element)


def string_of(element: ElementTree.Element) -> str:
    """Text of a shared or inline string, without phonetic runs."""
    parts = [element.findtext(f"{MAIN}t") or ""] + [run.findtext(f"{MAIN}t") or "" for run in element.findall(f"{MAIN}r")]
    return decoded("".join(parts))


def is_date_format(code: str) -> bool:
    return bool(re.search("[dmyhs]", _QUOTED.sub("", code).lower()))


class Workbook:
    """The sheets and cells of one opened .xlsx file."""

    def __init__(self, package: zipfile.ZipFile):
        self.package = package
        names = set(package.namelist())
        book = ElementTree.fromstring(package.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(package.read("xl/_rels/workbook.xml.rels"))}
        self.sheets = [
            (s.get("name"), posixpath.normpath(posixpath.join("/xl", targets[s.get(RELATION)])).lstrip("/"))
            for s in book.iter(f"{MAIN}sheet")
        ]
        properties = book.find(f"{MAIN}workbookPr")
        self.epoch = EPOCH_1904 if properties is not None and properties.get("date1904") in ("1", "true") else EPOCH
        self.strings = [string_of(e) for e in elements(package, "xl/sharedStrings.xml", f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        self.date_styles = self._date_styles() if "xl/styles.xml" in names else set()

    def _date_styles(self) -> set[int]:
        styles = ElementTree.fromstring(self.package.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")): is_date_format(f.get("formatCode") or "") for f in styles.iter(f"{MAIN}numFmt")}
        formats = styles.find(f"{MAIN}cellXfs")
        kinds = [int(x.get("numFmtId") or 0) for x in formats] if formats is not None else []
        return {i for i, k in enumerate(kinds) if own.get(k, k in DATE_FORMATS)}

    def cells(self, part: str) -> Iterator[tuple[int, int, str, str]]:
        """(row, column, kind, value) of a sheet, in order."""
        row = 0
        for line in elements(self.package, part, f"{MAIN}row"):
            row = int(line.get("r") or row + 1)
            column = 0
            for cell in line.findall(f"{MAIN}c"):
                column = column_number(cell.get("r") or "") or column + 1
                found = self.value(cell)
                if found is not None:
                    yield (row, column, *found)

    def value(self, cell: ElementTree.Element) -> tuple[str, str] | None:
        kind, raw = cell.get("t") or "n", cell.findtext(f"{MAIN}v")
        if kind == "inlineStr":
            inline = cell.find(f"{MAIN}is")
            return None if inline is None else ("text", string_of(inline))
        if raw is None:
            return None
        if kind == "s":
            return "text", self.strings[int(raw)]
        if kind == "b":
            return "boolean", "true" if raw in ("1", "true") else "false"
        if kind == "n" and int(cell.get("s") or 0) in self.date_styles:
            return "date", self.moment(float(raw))
        return {"str": "text", "e": "error", "d": "date"}.get(kind, "number"), decoded(raw)

    def moment(self, days: float) -> str:
        """A serial number of days as a date, or a time stamp if it is no whole day."""
        made = self.epoch + datetime.timedelta(milliseconds=round(days * 86_400_000))
        return made.date().isoformat() if days == int(days) else made.isoformat(sep=" ", timespec="seconds")


def paragraphs(package: zipfile.ZipFile) -> Iterator[str]:
    """Texts of the paragraphs that stand in the body itself, in order."""
    body = ElementTree.fromstring(package.read("word/document.xml")).find(f"{WORD}body")
    marks = {f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n"}
    for paragraph in body.findall(f"{WORD}p") if body is not None else ():
        yield "".join(e.text or "" if e.tag == f"{WORD}t" else marks.get(e.tag, "") for run in paragraph.iter(f"{WORD}r") for e in run)


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    paths: list[str]


def listed(options, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that the options name, folders with all that is below them."""
    names = json.loads(options["paths"]) if "paths" in options else [options["path"]]
    found = []
    for name in names:
        system, path = fs.FileSystem.from_uri(name) if "://" in name or name.startswith("file:") else (fs.LocalFileSystem(), name)
        prefix = name[: len(name) - len(path)] if name.endswith(path) else ""
        info = system.get_file_info(path)
        if info.type == fs.FileType.Directory:
            infos = system.get_file_info(fs.FileSelector(path, recursive=True))
            found += [(prefix + i.path, i.size) for i in infos if i.type == fs.FileType.File and i.path.lower().endswith(suffix)]
        else:
            found.append((prefix + path, info.size or 0))
    return sorted(found)


def packed(files: list[tuple[str, int]]) -> list[Files]:
    parts: list[Files] = []
    room = 0
    for path, size in files:
        if size + OPENING > room or not parts:
            parts.append(Files([]))
            room = PACKED
        parts[-1].paths.append(path)
        room -= size + OPENING
    return parts or [Files([])]


def opened(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


#: What a damaged package raises while it is read.
DAMAGED = (zipfile.BadZipFile, KeyError, IndexError, ValueError, ElementTree.ParseError, OSError, EOFError, NotImplementedError)


class OfficeReader(DataSourceReader):
    suffix = ""

    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return packed(listed(self.options, self.suffix))

    def read(self, partition):
        rows: list[tuple] = []
        for path in partition.paths:
            for row in self.rows(path):
                rows.append(row)
                if len(rows) == BATCH:
                    yield self.batch(rows)
                    rows = []
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), self.fields, strict=True)], schema=self.fields
        )


class WorkbookReader(OfficeReader):
    suffix = ".xlsx"
    fields = pa.schema([(n, pa.int32() if n in ("place", "row", "column") else pa.string()) for n in ("path", "place", "sheet", "row", "column", "kind", "value")])

    def rows(self, path: str) -> Iterator[tuple]:
        place = sheet = None
        try:
            with opened(path) as file, zipfile.ZipFile(file) as package:
                book = Workbook(package)
                for place, (sheet, part) in enumerate(book.sheets, 1):
                    for row, column, kind, value in book.cells(part):
                        yield path, place, sheet, row, column, kind, value
        except DAMAGED as error:
            yield path, place, sheet, None, None, "error", f"{type(error).__name__}: {error}"


class WordReader(OfficeReader):
    suffix = ".docx"
    fields = pa.schema([(n, pa.string()) for n in ("path", "text", "error")])

    def rows(self, path: str) -> Iterator[tuple]:
        try:
            with opened(path) as file, zipfile.ZipFile(file) as package:
                yield path, "\n".join(paragraphs(package)), None
        except DAMAGED as error:
            yield path, None, f"{type(error).__name__}: {error}"


@dataclass
class Written(WriterCommitMessage):
    """Files of one task under their temporary names, with the names that they get."""

    files: list[tuple[str, str]]


class OfficeWriter(DataSourceWriter):
    """Tasks write under temporary names; the commit gives those of successful tasks their own."""

    suffix = ""

    def __init__(self, options, schema, overwrite: bool):
        self.path, self.schema = options["path"].rstrip("/"), schema
        system, inner = self.system()
        if overwrite and system.get_file_info(inner).type == fs.FileType.Directory:
            system.delete_dir_contents(inner)

    def system(self):
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator):
        system, folder = self.system()
        system.create_dir(folder, recursive=True)
        written = []
        for name, package in self.packages(iterator):
            own = f"{folder}/.{uuid.uuid4().hex}.tmp"
            with system.open_output_stream(own) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zipped:
                for part, body in package:
                    with zipped.open(part, "w") as to:
                        for piece in body:
                            to.write(piece.encode("utf-8", "replace"))
            written.append((own, f"{folder}/{name}{self.suffix}"))
        return Written(written)

    def commit(self, messages):
        system, _ = self.system()
        for message in messages:
            for own, name in message.files if message else ():
                system.move(own, name)

    def abort(self, messages):
        system, _ = self.system()
        for message in messages:
            for own, _ in message.files if message else ():
                system.delete_file(own)


class WorkbookWriter(OfficeWriter):
    suffix = ".xlsx"

    def packages(self, iterator):
        iterator = iter(iterator)
        head = next(iterator, None)
        while head is not None:
            shared: dict[str, int] = {}
            rows = [head]
            for row in iterator:
                if len(rows) == SHEET_ROWS:
                    head = row
                    break
                rows.append(row)
            else:
                head = None
            yield f"part-{uuid.uuid4().hex}", self.parts(rows, shared)

    def parts(self, rows, shared: dict[str, int]):
        yield "[Content_Types].xml", [TYPES.format("".join(PART.format(f"xl/{p}.xml", f"spreadsheetml.{k}") for p, k in (
            ("workbook", "sheet.main"), ("worksheets/sheet1", "worksheet"), ("styles", "styles"), ("sharedStrings", "sharedStrings"),
        )))]
        yield "_rels/.rels", [RELATIONS.format(RELATED.format(1, "officeDocument", "xl/workbook.xml"))]
        yield "xl/_rels/workbook.xml.rels", [RELATIONS.format("".join(RELATED.format(i, k, t) for i, k, t in (
            (1, "worksheet", "worksheets/sheet1.xml"), (2, "styles", "styles.xml"), (3, "sharedStrings", "sharedStrings.xml"),
        )))]
        space = f'xmlns="{MAIN[1:-1]}"'
        yield "xl/workbook.xml", [f'<workbook {space} xmlns:r="{RELATION[1:-3]}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>']
        # style 1 shows days, style 2 days and times
        yield "xl/styles.xml", [f'<styleSheet {space}><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="22"/></cellXfs></styleSheet>']
        yield "xl/worksheets/sheet1.xml", self.sheet(rows, shared, space)
        yield "xl/sharedStrings.xml", [
            f"<sst {space}>", *(f'<si><t xml:space="preserve">{encoded(t)}</t></si>' for t in shared), "</sst>",
        ]

    def sheet(self, rows, shared: dict[str, int], space: str):
        yield f"<worksheet {space}><sheetData>"
        for at, row in enumerate([self.schema.fieldNames(), *rows], 1):
            yield f'<row r="{at}">' + "".join(
                self.cell(f"{column_letters(i)}{at}", value, shared) for i, value in enumerate(row, 1) if value is not None
            ) + "</row>"
        yield "</sheetData></worksheet>"

    def cell(self, reference: str, value, shared: dict[str, int]) -> str:
        if isinstance(value, bool):
            return f'<c r="{reference}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, datetime.datetime):
            return f'<c r="{reference}" s="2"><v>{(value.replace(tzinfo=None) - EPOCH) / datetime.timedelta(days=1)!r}</v></c>'
        if isinstance(value, datetime.date):
            return f'<c r="{reference}" s="1"><v>{(value - EPOCH.date()).days}</v></c>'
        if isinstance(value, (int, Decimal)) or isinstance(value, float) and value - value == 0:
            return f'<c r="{reference}"><v>{value}</v></c>'
        return f'<c r="{reference}" t="s"><v>{shared.setdefault(str(value), len(shared))}</v></c>'


class WordWriter(OfficeWriter):
    suffix = ".docx"

    def packages(self, iterator):
        for name, text in iterator:
            yield name, self.parts(text or "")

    def parts(self, text: str):
        yield "[Content_Types].xml", [TYPES.format(PART.format("word/document.xml", "wordprocessingml.document.main"))]
        yield "_rels/.rels", [RELATIONS.format(RELATED.format(1, "officeDocument", "word/document.xml"))]
        lines = (f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in re.sub(_CONTROL, "\ufffd", text).split("\n"))
        yield "word/document.xml", [f'<w:document xmlns:w="{WORD[1:-1]}"><w:body>', *lines, "</w:body></w:document>"]


class WorkbookSource(DataSource):
    """Cells of .xlsx files; writes the rows of a frame, at most ``SHEET_ROWS`` a file."""

    reads, writes, fields = WorkbookReader, WorkbookWriter, CELLS

    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        return self.fields

    def reader(self, schema):
        return self.reads(self.options)

    def writer(self, schema, overwrite):
        return self.writes(self.options, schema, overwrite)


class WordSource(WorkbookSource):
    """Texts of .docx files; writes one file for each (name, text)."""

    reads, writes, fields = WordReader, WordWriter, TEXTS

    @classmethod
    def name(cls):
        return "wordfile"


def register(spark: SparkSession) -> None:
    """Make both formats known to the session."""
    spark.dataSource.register(WorkbookSource)
    spark.dataSource.register(WordSource)


def read_workbooks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, place, sheet, row, column, kind, value): the cells of workbooks of any columns, in one scan."""
    register(spark)
    return spark.read.format("workbook").option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths))).load()


def read_word_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text, error) of word-processor files."""
    register(spark)
    return spark.read.format("wordfile").option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths))).load()


def table_rows(cells: DataFrame, columns: list[str]) -> DataFrame:
    """(path, place, sheet, row, columns): the rows below a sheet's first, by the names that its first row gives.

    A column that a sheet does not have is null; of columns with one name the leftmost counts.
    """
    own = ["path", "place", "sheet"]
    good = cells.where("row is not null")
    placed = good.join(good.groupBy(*own).agg(F.min("row").alias("start")), own)
    heads = placed.where("row = start").groupBy(*own, F.col("value").alias("name")).agg(F.min("column").alias("column"))
    named = placed.where("row > start").join(heads, [*own, "column"])
    return named.groupBy(*own, "row").pivot("name", columns).agg(F.first("value"))


def sheet_texts(cells: DataFrame, max_lines: int) -> DataFrame:
    """(path, text): the first sheet of each workbook as its header and its distinct lines, cells joined by a pipe.

    A sheet with ``max_lines`` rows or more below the header is not listed: its text is null.
    """
    good = cells.where("row is not null")
    first = good.groupBy("path").agg(F.min("place").alias("place"))
    lines = good.join(first, ["path", "place"]).groupBy("path", "row").agg(
        F.array_sort(F.collect_list(F.struct("column", F.replace("value", F.lit("\n"), F.lit(",")).alias("value")))).alias("of")
    ).select("path", "row", F.array_join(F.col("of.value"), "|").alias("line"))
    once = lines.groupBy("path", "line").agg(F.min("row").alias("row"), F.count("*").alias("n"))
    sizes = once.groupBy("path").agg((F.sum("n") - 1).alias("n"))
    short = once.join(sizes.where(F.col("n") < max_lines), "path", "left_semi").groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("row", "line"))).alias("of")
    ).select("path", F.array_join(F.col("of.line"), "\n").alias("text"))
    return sizes.select("path").join(short, "path", "left")
