import datetime
import zipfile

import pytest

from tablewright.sources import files as S
from tablewright.sources import office as O

ROWS = [
    (1, "plain", True, 1.5, datetime.date(2024, 2, 29), datetime.datetime(2024, 2, 29, 6, 30)),
    (2, "<a> & \"b\"\nline two\x07 _x0041_ \u00e9", False, None, None, None),
    (3, None, None, 1e300, datetime.date(1950, 1, 1), None),
]
SCHEMA = "n int, t string, b boolean, d double, day date, at timestamp_ntz"


def package(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return str(path)


def book(path, sheets, strings="", styles="", properties=""):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    parts = {
        "xl/workbook.xml": f"<workbook {space}>{properties}<sheets>" + "".join(
            f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships>" + "".join(
            f'<Relationship Id="r{i}" Target="{"/xl/" if i else ""}w/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>",
    } | {f"xl/w/s{i}.xml": f"<worksheet {space}><sheetData>{body}</sheetData></worksheet>" for i, body in enumerate(sheets.values())}
    if strings:
        parts["xl/sharedStrings.xml"] = f"<sst {space}>{strings}</sst>"
    if styles:
        parts["xl/styles.xml"] = f"<styleSheet {space}>{styles}</styleSheet>"
    return package(path, parts)


def test_rows_come_back(spark, tmp_path):
    O.register(spark)
    df = spark.createDataFrame(ROWS, SCHEMA)
    df.repartition(2).write.format("workbook").mode("append").save(str(tmp_path / "out"))
    assert all(p.suffix == ".xlsx" for p in (tmp_path / "out").iterdir())
    found = O.table_rows(O.read_workbooks(spark, str(tmp_path / "out")), df.columns)
    got = found.select(*[O.F.col(f.name).cast(f.dataType) for f in df.schema]).collect()
    assert sorted(map(tuple, got)) == ROWS


def test_cells_of_a_foreign_workbook(spark, tmp_path):
    path = book(
        tmp_path / "a b.xlsx",
        {
            "First": '<row r="2"><c r="B2" t="s"><v>0</v></c><c r="AA2" t="inlineStr"><is><t>in</t><r><t>line</t></r></is></c></row>'
            '<row><c><v>7</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="str"><v>f</v></c><c s="1"><v>60.5</v></c><c s="2"><v>45351</v></c><c s="3"><v>3</v></c><c/></row>',
            "Second": "",
            "Third": '<row r="1"><c r="A1" t="d"><v>2020-01-01</v></c></row>',
        },
        "<si><r><t>rich </t></r><r><t>text</t></r><rPh><t>no</t></rPh></si>",
        '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.0 &quot;days&quot;"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>',
    )
    got = O.read_workbooks(spark, path).orderBy("place", "row", "column").collect()
    assert {r.path for r in got} == {path}
    assert [(r.place, r.sheet, r.row, r.column, r.kind, r.value) for r in got] == [
        (1, "First", 2, 2, "text", "rich text"), (1, "First", 2, 27, "text", "inline"),
        (1, "First", 3, 1, "number", "7"), (1, "First", 3, 2, "boolean", "true"), (1, "First", 3, 3, "error", "#N/A"),
        (1, "First", 3, 4, "text", "f"), (1, "First", 3, 5, "date", "1900-02-28 12:00:00"), (1, "First", 3, 6, "date", "2024-02-29"),
        (1, "First", 3, 7, "number", "3"), (3, "Third", 1, 1, "date", "2020-01-01"),
    ]


def test_dates_from_1904(spark, tmp_path):
    path = book(tmp_path / "a.xlsx", {"S": '<row><c s="0"><v>1</v></c></row>'}, "", '<cellXfs><xf numFmtId="14"/></cellXfs>', '<workbookPr date1904="1"/>')
    assert O.read_workbooks(spark, path).first().value == "1904-01-02"


@pytest.mark.parametrize("place, letters", [(1, "A"), (26, "Z"), (27, "AA"), (702, "ZZ"), (703, "AAA")])
def test_columns(place, letters):
    assert O.column_letters(place) == letters and O.column_number(letters + "12") == place


def test_damaged_files_are_reported(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(b"no zip")
    (tmp_path / "b.docx").write_bytes(b"")
    cut = book(tmp_path / "c.xlsx", {"S": "<row><c><v>1</v></c></row>"})
    with open(cut, "r+b") as f:
        f.truncate(100)
    good = book(tmp_path / "d.xlsx", {"S": "<row><c><v>1</v></c></row>", "T": "<row><c t='s'><v>9</v></c></row>"})
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in O.read_workbooks(spark, str(tmp_path)).where("row is null").collect()}
    assert kinds == {"a.xlsx": "error", "c.xlsx": "error", "d.xlsx": "error"}
    assert O.read_workbooks(spark, good).where("row is not null").count() == 1
    empty = O.read_word_files(spark, str(tmp_path / "b.docx")).first()
    assert empty.text is None and empty.error


def test_paragraphs_of_the_body(spark, tmp_path):
    body = (
        "<w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t><w:br/></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>"
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/><w:p><w:r><w:t>end</w:t></w:r></w:p>"
    )
    path = package(tmp_path / "a.docx", {
        "word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'
    })
    assert O.read_word_files(spark, path).first().text == "one\ttwo\nlink\n\nend"


def test_sidecars_of_office_formats(spark, tmp_path):
    O.register(spark)
    first = book(tmp_path / "a.xlsx", {"Z": '<row><c t="str"><v>x</v></c><c t="str"><v>y</v></c></row><row><c><v>1</v></c></row><row><c><v>1</v></c></row>', "A": "<row><c><v>5</v></c></row>"})
    long = book(tmp_path / "b.xlsx", {"S": "".join(f"<row><c><v>{i % 7}</v></c></row>" for i in range(301))})
    (tmp_path / "c.docx").write_bytes(b"?")
    (tmp_path / "d.xls").write_bytes(b"?")
    paths = [first, long, str(tmp_path / "c.docx"), str(tmp_path / "d.xls")]
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.text, r.status) for r in S.read_sidecars(spark, paths).collect()}
    assert got == {
        "a.xlsx": ("xlsx", "x|y\n1", "read"), "b.xlsx": ("xlsx", None, "too long"),
        "c.docx": ("docx", None, "damaged"), "d.xls": ("xls", None, "no reader"),
    }


def test_variable_notes(spark, tmp_path):
    O.register(spark)
    names = list(S.VARIABLE_HEADERS.values())
    df = spark.createDataFrame([("v1", "l1", "d1", "1; 2", None), ("v2", None, "d2", None, "9")], ", ".join(f"`{n}` string" for n in names))
    df.coalesce(1).write.format("workbook").mode("append").save(str(tmp_path / "v"))
    got = S.read_variable_notes(spark, [str(tmp_path / "v")]).drop("path").collect()
    assert sorted(map(tuple, got)) == [("v1", "l1", "d1", "1; 2", None), ("v2", None, "d2", None, "9")]


def test_nothing(spark, tmp_path):
    (tmp_path / "e").mkdir()
    assert O.read_workbooks(spark, str(tmp_path / "e")).count() == 0


def test_documents_of_any_columns_in_one_scan(spark, tmp_path):
    for name, text in (("a", "x,y\n1,\"p,\nq\"\n,2\n"), ("b", "z\n5\n5\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    got = {r.path[-5:]: r.text for r in S.read_sidecars(spark, paths).collect()}
    assert got == {"a.csv": "x|y\n1|p,,q\n2", "b.csv": "z\n5"}
