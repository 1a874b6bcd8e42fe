"""Profile states: merged parts against the whole, sketches against their bounds."""

import math

import pytest
from pyspark.sql import functions as F

from tablewright.operators import states as St
from tablewright.operators.profile import column_stats

EXACT = ["column", "dtype", "total_vals", "num_nans", "min_val", "max_val"]


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    return spark.range(0, 20000, numPartitions=5).select(
        F.when(n % 7 != 0, n % 5).alias("part"),
        F.when(n % 11 != 0, (n * 13) % 4001).alias("whole"),
        F.when(n % 3 == 0, F.lit(float("nan"))).when(n % 3 == 1, 1e9 + n / 7).alias("far"),
        F.concat(F.lit("v"), F.least(n % 9973 % 50, n % 10).cast("string")).alias("few"),
        F.concat(F.lit("x" * 70), n % 900).alias("long"),
        (n % 2 == 0).alias("flag"),
        F.lit(None).cast("string").alias("nothing"),
    )


COLUMNS = ["whole", "far", "few", "long", "flag", "nothing"]


def by_column(df, names):
    return {r["column"]: [r[n] for n in names] for r in df.collect()}


def test_merged_parts_equal_the_whole(spark, rows):
    parts = St.column_states(rows, COLUMNS, [F.col("part"), (F.col("whole") % 2).alias("odd")])
    twice = St.merged_states(St.merged_states(parts, ["part"]))
    got = St.state_stats(twice)
    want = column_stats(rows, COLUMNS)
    assert by_column(got, EXACT) == by_column(want, EXACT)
    a = by_column(got, ["mean", "std_dev", "num_of_dist_val"])
    b = by_column(want, ["mean", "std_dev", "num_of_dist_val"])
    for c in COLUMNS:
        assert a[c][0] == pytest.approx(b[c][0], rel=1e-12)
        assert a[c][1] == pytest.approx(b[c][1], rel=1e-7)
        assert abs(a[c][2] - b[c][2]) <= St.distinct_bound() * b[c][2]


def test_merged_columns_are_those_of_a_state(rows):
    one = St.column_states(rows, COLUMNS)
    assert sorted(St.merged_states(one).dtypes) == sorted(one.dtypes)


def test_heavy_hitters_of_few_values_are_exact(rows):
    parts = St.column_states(rows, ["few", "flag", "nothing"], [F.col("part")])
    got = {(r["column"], r["value"]): r["n"] for r in St.state_heavy_hitters(St.merged_states(parts)).collect()}
    want = {("few", r["few"]): r["count"] for r in rows.groupBy("few").count().collect()}
    want |= {("flag", str(r["flag"]).lower()): r["count"] for r in rows.groupBy("flag").count().collect()}
    assert got == want


def test_heavy_hitters_of_many_values_keep_their_bound(spark):
    n = F.col("id")
    df = spark.range(60000).select(F.when(n % 4 == 0, F.lit(-1)).otherwise(n).alias("v"), (n % 3).alias("part"))
    merged = St.merged_states(St.column_states(df, ["v"], [F.col("part")]))
    top = St.state_heavy_hitters(merged, 1).first()
    assert top["value"] == "-1" and abs(top["n"] - 15000) <= St.heavy_bound() * 60000


def test_category_sizes(rows):
    states = St.merged_states(St.column_states(rows, COLUMNS, [F.col("part")]))
    assert {r["column"]: r["category_size"] for r in St.state_category_size(states).collect()} == {
        "whole": "none", "far": "none", "few": "small", "long": "none", "flag": "binary", "nothing": "binary",
    }


def test_empty_tables(rows):
    empty = rows.limit(0)
    assert St.column_states(empty, COLUMNS, [F.col("part")]).count() == 0
    whole = St.merged_states(St.column_states(empty, COLUMNS))
    got = by_column(St.state_stats(whole), ["total_vals", "num_of_dist_val", "mean", "pct_nans"])
    assert got == {c: [0, 0, 0.0, None] for c in COLUMNS}
    assert whole.select(St.quantile(F.col("ranks"), 0.5).alias("q")).distinct().collect()[0]["q"] is None
    assert St.state_heavy_hitters(whole).count() == 0


def test_quantiles_of_states_and_groups(rows):
    states = St.merged_states(St.column_states(rows, ["far", "nothing"], [F.col("part")]))
    found = by_column(states.select("column", *[St.quantile(F.col("ranks"), p).alias(f"q{p}") for p in (0, 0.3, 1)]), ["q0", "q0.3", "q1"])
    assert found["nothing"] == [None] * 3
    values = sorted(r["far"] for r in rows.select("far").collect() if r["far"] is not None and not math.isnan(r["far"]))
    assert [found["far"][0], found["far"][2]] == [values[0], values[-1]]
    below = sum(v < found["far"][1] for v in values) / len(values)
    assert abs(below - 0.3) <= St.rank_bound() + 1 / len(values)
    groups = St.sketched_quantiles(rows, ["part"], "whole", [0, 1], ["low", "high"]).collect()
    want = rows.groupBy("part").agg(F.count("whole"), F.min("whole"), F.max("whole")).collect()
    assert {tuple(r) for r in groups} == {tuple(r) for r in want}
