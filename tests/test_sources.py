import json

import pytest

from tablewright.operators.lineage import write_lineage
from tablewright.sources import files as S


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_latin1_file_is_read_in_its_encoding(spark, tmp_path):
    good = write(tmp_path / "t" / "a.csv", "name,n\nZoë,1\n")
    bad = write(tmp_path / "t" / "b.csv", "name,n\ncafé,2\n", "latin-1")
    assert [p.rsplit("/", 1)[1] for p in S.badly_encoded(spark, [good, bad])] == ["b.csv"]
    got = S.read_table(spark, [good, bad])
    assert sorted(map(tuple, got.collect())) == [("Zoë", 1), ("café", 2)]


def test_names_with_blanks_and_percent_signs(spark, tmp_path):
    good = write(tmp_path / "t" / "a 1%.csv", "name,n\nZoë,1\n")
    bad = write(tmp_path / "t" / "b c.csv", "name,n\ncafé,2\n", "latin-1")
    got = S.read_table(spark, [good, bad])
    assert sorted(map(tuple, got.collect())) == [("Zoë", 1), ("café", 2)]


def test_line_breaks_inside_cells(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'name,n\n"two\nlines",1\n')
    assert [tuple(r) for r in S.read_table(spark, path, multi_line=True).collect()] == [("two\nlines", 1)]


def test_unreadable_table_is_skipped(spark, tmp_path):
    good = write(tmp_path / "a.csv", "x\n1\n")
    with pytest.warns(UserWarning):
        got = S.read_tables(spark, {"a": good, "b": str(tmp_path / "none.csv")})
    assert list(got) == ["a"]


def test_metadata_scan(spark, tmp_path):
    write(tmp_path / "p" / "d1" / "metadata.json", json.dumps({"dataset_title": "T", "license": "us-pd", "publisher": "P"}))
    write(tmp_path / "p" / "d2" / "metadata.json", json.dumps({"dataset_title": "U", "license": ""}))
    write(tmp_path / "p" / "d3" / "metadata.json", "{ not json")
    got = {r["path"]: r for r in S.read_metadata(spark, str(tmp_path)).collect()}
    assert set(got) == {"p/d1", "p/d2"}
    assert got["p/d2"]["license"] == "<MISSING>" and got["p/d1"]["publisher"] == "P"


def test_keyed_json(spark, tmp_path):
    write(tmp_path / "src" / "ds" / "q1" / "pairs.json", '{"match": true}')
    write(tmp_path / "src" / "pairs.json", '{"match": false}')
    got = S.read_keyed_json(spark, str(tmp_path), "pairs.json", "match boolean").collect()
    assert [tuple(r) for r in got] == [("src", "ds", "q1", True)]


@pytest.mark.parametrize("columns, want", [
    ([{"name": "a", "description": "first"}, {"name": "z", "description": None}, {"name": "b", "description": ""}], [("a", "first")]),
    ([{"name": "a", "description": "first"}, {"name": "b", "description": None}], []),
])
def test_column_notes(spark, tmp_path, columns, want):
    path = write(tmp_path / "n.json", json.dumps({"meta": {"view": {"columns": columns}}}))
    assert [tuple(r) for r in S.read_column_notes(spark, path, ["a", "b"]).collect()] == want


def test_column_notes_of_a_list_are_nothing(spark, tmp_path):
    path = write(tmp_path / "n.json", '[{"meta": {"view": {"columns": [{"name": "a", "description": "x"}]}}}]')
    assert S.read_column_notes(spark, path, ["a"]).count() == 0
    assert S.read_column_notes(spark, write(tmp_path / "o.json", "{}"), ["a"]).count() == 0


def test_sidecars_by_extension(spark, tmp_path):
    paths = [
        write(tmp_path / "a.csv", "x,y\n1,p\n1,p\n2,\n"),
        write(tmp_path / "a.txt", "line one\nline two"),
        write(tmp_path / "a.xml", "<r><a>one</a> <b>two</b></r>"),
        write(tmp_path / "a.html", "<p>Hi</p><script>no()</script>"),
        write(tmp_path / "a.pdf", "%PDF"),
    ]
    got = {r["kind"]: (r["text"], r["status"]) for r in S.read_sidecars(spark, paths).collect()}
    assert got["csv"] == ("x|y\n1|p\n2", "read")
    assert got["txt"][0] == "line one\nline two" and got["xml"][0] == "one\ntwo" and got["html"][0] == "Hi"
    assert got["pdf"] == (None, "no reader")


def test_labelled_profiles_and_lineage_export(spark, tmp_path):
    path = write(tmp_path / "f.csv", "Attribute_name,subcategory\na,url\nb,drop\n")
    assert [r["Attribute_name"] for r in S.read_labelled_profiles(spark, path, ["url"]).collect()] == ["a"]
    nodes = spark.createDataFrame([("Q_0_0", "QA")], "id string, type string")
    edges = spark.createDataFrame([("I_0_0", "Q_0_0")], "source string, target string")
    write_lineage(nodes, edges, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g" / "links")).count() == 1
    S.write_json(nodes, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).collect() == nodes.collect()
