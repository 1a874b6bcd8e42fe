import re
from collections import Counter

import pytest

from tablewright.llm import mixing
from tests.llm.helpers import documents, odd


def plain_targets(sizes, weights=(5, 2, 1), share=1.5):
    """Share out by weight, stop what is full, share its excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    target, left, full = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set()
    while left > 1e-9 and len(full) < len(names):
        total = sum(weight[n] for n in names if n not in full)
        given, left = left, 0.0
        for n in names:
            if n not in full:
                target[n] += given * weight[n] / total
        for n in names:
            if n not in full and target[n] >= 2 * sizes[n]:
                left += target[n] - 2 * sizes[n]
                target[n], _ = 2.0 * sizes[n], full.add(n)
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 50, "d": 70, None: 9}, {"a": 5}, {"a": 0, "b": 3}, {"b": 0},
])
def test_targets(sizes):
    got = {n: t for n, _, t in mixing.source_targets(list(sizes.items()))}
    assert got == pytest.approx(plain_targets(sizes))


def test_odd_rows_and_sums(spark):
    rows = odd() + [(100 + i, "w " * (1 + i % 17), "en", f"s{i % 5}") for i in range(300)]
    docs = documents(spark, rows, clash=("size", "target", "place", "range"))
    mixed = [r.asDict() for r in mixing.mix(docs).collect()]
    assert len(mixed) == len(rows)
    assert sum(m["taken"] for m in mixed) == pytest.approx(1.5 * sum(m["size"] for m in mixed), abs=10)
    for m in mixed:
        assert 0 <= m["taken"] <= 2 * m["size"]
    for source in {m["source"] for m in mixed}:
        own = [m for m in mixed if m["source"] == source]
        assert abs(sum(m["taken"] for m in own) - own[0]["target"]) <= 1
    again = [r.asDict() for r in mixing.mix(docs.repartition(7)).collect()]
    key = lambda m: str(sorted(m.items(), key=str))
    assert sorted(map(key, mixed)) == sorted(map(key, again))


def test_mixed_texts(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(3 + i % 9)), "en", "ab"[i % 2]) for i in range(80)]
    docs = documents(spark, rows)
    planned = {r.doc_id: r for r in mixing.mix(docs).collect()}
    times = Counter()
    for r in mixing.mixed_documents(docs).collect():
        assert rows[r.doc_id][1] == r.text
        times[r.doc_id] += 1
    for i, r in planned.items():
        assert abs(times[i] * r.size - r.taken) <= r.size / 2
    for source in "ab":
        own = [r for r in planned.values() if r.source == source]
        assert abs(sum(times[r.doc_id] * r.size for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1


def test_mixed_columns_of_any_name(spark):
    rows = [(i, "w " * (1 + i % 5), "en", f"s{i % 3}") for i in range(30)]
    docs = documents(spark, rows, clash=("size", "target", "taken", "finish", "row", "pass", "place", "range", "end"))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert {r["size"] for r in mixed.collect()} == {"x"}


def test_empty_table(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.mixed_documents(documents(spark, [])).count() == 0


def test_whole_rows_move_twice(spark, capsys):
    """To their range, for join and sums, and to their place in the mix."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mixing.mixed_documents(documents(spark, [(i, "w " * (1 + i % 5), "en", f"s{i % 3}") for i in range(30)])).explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[.*\brow#", capsys.readouterr().out)
    assert len(moved) == 2
