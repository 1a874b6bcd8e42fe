import random

import pytest

from tablewright.llm import components as C


def plain(edges):
    least = {x: x for e in edges for x in e}
    while True:
        now = dict(least)
        for a, b in edges:
            now[a] = now[b] = min(now[a], now[b])
        if now == least:
            return least
        least = now


def some_edges():
    rng = random.Random(4)
    path = list(range(40))
    rng.shuffle(path)
    star = [(100, 101 + i) for i in range(60)]
    web = [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    return [*zip(path, path[1:]), *star, *web, (7, 7), (300, 301), (301, 300), (300, 301)]


@pytest.mark.parametrize("name", [int, lambda n: f"n{n:04d}"])
def test_against_plain_groups(spark, name):
    edges = [(name(a), name(b)) for a, b in some_edges()]
    kind = "string" if isinstance(edges[0][0], str) else "long"
    got = {r.node: r.component for r in C.components(spark.createDataFrame(edges, f"a {kind}, b {kind}")).collect()}
    assert got == {n: c for n, c in plain([e for e in edges if e[0] != e[1]]).items()}
    assert not C.components(spark.createDataFrame([], f"a {kind}, b {kind}")).collect()


def test_a_round_moves_rows_four_times(spark, monkeypatch, capsys):
    """Sum and join, twice; the plan shows the first two in both uses of them, which run once."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    moved, kept = [], C.written

    def shown(df, label="rows"):
        df.explain("formatted")
        moved.append(capsys.readouterr().out.count(") Exchange\n"))
        return kept(df, label)

    monkeypatch.setattr(C, "written", shown)
    try:
        C.components(spark.createDataFrame(some_edges(), "a long, b long"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert moved[0] == 1 and max(moved[1:]) <= 6
