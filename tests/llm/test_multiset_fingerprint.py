import hashlib

import pytest
from pyspark.sql import functions as F

from tablewright.llm import multiset_fingerprint as mf
from tests.conftest import SF
from tests.llm.helpers import documents, odd


def prints(spark, texts):
    df = mf.fingerprints(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"))
    return [r.fingerprint for r in df.orderBy("i").collect()]


def test_order_does_not_count_and_repeats_do(spark):
    a, b, c, d, e, f = prints(spark, ["one.\ntwo.\nthree.", "three.\none.\ntwo.", "one.\ntwo.", "one.\ntwo.\ntwo.", "", None])
    assert a == b and len({tuple(x) for x in (a, c, d)}) == 3
    assert e == f == [0] * len(e)


def test_insert_and_delete(spark):
    rows = [("one. and\ntwo", "three\nfour. five", "one. and\ntwo\nthree\nfour. five")]
    df = spark.createDataFrame(rows, "a string, b string, ab string")
    for name in ("a", "b", "ab"):
        df = mf.fingerprints(df, name, f"{name}_print")
    r = df.select(
        (mf.insert(F.col("a_print"), F.col("b_print")) == F.col("ab_print")).alias("joined"),
        (mf.delete(F.col("ab_print"), F.col("b_print")) == F.col("a_print")).alias("left"),
        (mf.delete(F.col("a_print"), F.col("a_print")) == F.transform("a_print", lambda x: F.lit(0).cast("long"))).alias("none"),
    ).first()
    assert r.joined and r.left and r.none


def check(rows, texts):
    order = sorted(range(len(texts)), key=lambda i: (texts[i][0] is None, -(texts[i][0] or 0), texts[i][1] or ""))
    want = []
    for place, i in enumerate(order):
        own, after = texts[i][1] or "", texts[order[(place + 1) % len(order)]][1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        want.append((texts[i][0], len(own), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=str) == sorted(want, key=str)
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert len(r.fingerprint) == 16 * (1 + 16 * len(mf.SEEDS))
        if r.fingerprint == r.edited_fingerprint:
            assert r.near_edited == 1


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = mf.edited_fingerprints(docs).collect()
    check(rows, texts)
    by_text = {}
    for r in rows:
        by_text.setdefault(dict(texts)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    long = [r for r in rows if r.n_chars > 1000]
    assert sum(r.near_edited for r in long) / len(long) > 0.3 > 0.2 > sum(r.near_next for r in long) / len(long)


@pytest.mark.parametrize("rows", [odd("A sentence here. " * 3000), [(5, "alone.\nreally", "en", "a")], [(3, None, "en", "a"), (9, "x", "en", "a")]])
def test_odd_rows(spark, rows):
    docs = documents(spark, rows, clash=("own", "next", "bucket", "copy"))
    check(mf.edited_fingerprints(docs).collect(), [(r[0], r[1]) for r in rows])


def test_empty_table(spark):
    assert mf.edited_fingerprints(documents(spark, [])).count() == 0


def test_a_very_frequent_line_does_not_wrap(spark):
    line = "the same line again"
    rows = [
        (1, "\n".join([line] * 9_000), "\n".join([line] * 4_500 + [f"other {i % 50}" for i in range(4_500)])),
        (2, "\n".join([line] * 16_384), ""),
        (3, "\n".join([line] * 3), "\n".join([line] * 16_387)),
    ]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    both = mf.with_signs(mf.fingerprints(mf.fingerprints(df, "a", "x"), "b", "y"), "x", "y")
    one, two, three = both.select("x", "y", mf.likeness("x", "y").alias("like")).orderBy("i").collect()
    # the cosine of the two multisets is 4500 / sqrt(4500**2 + 50 * 90**2)
    assert one.like > 0.9
    assert two.x != two.y and two.x[0] == 16_384 and two.like == 0
    assert three.x != three.y and three.y[0] == 16_387 and three.like > 0.99
