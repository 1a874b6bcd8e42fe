import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tablewright.operators import modelling as Mo
from tablewright.operators import transforms as X
from tablewright.streaming.apply import stream_table, transform_stream


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("k").collect()]


def test_standardize_uses_population_deviation(spark):
    df = frame(spark, [(1, 1.0, 5.0), (2, 3.0, 5.0), (3, None, 5.0)], "k int, a double, b double")
    got = X.Standardize(["a", "b"]).fit(df).transform(df)
    assert values(got, "a", "b") == [(-1.0, 0.0), (1.0, 0.0), (None, 0.0)]


@pytest.mark.parametrize("inline", [10, 0])
def test_ordinal_codes_and_unseen(spark, inline):
    train = frame(spark, [(1, "b"), (2, "a"), (3, "b"), (4, None)], "k int, c string")
    new = frame(spark, [(1, "a"), (2, "z"), (3, None), (4, "b")], "k int, c string")
    model = X.OrdinalEncode(["c"], inline=inline).fit(train)
    assert values(model.transform(new), "c") == [(0,), (-1,), (-1,), (1,)]


def test_ordinal_orders_numbers_by_value(spark):
    df = frame(spark, [(1, 10), (2, 9), (3, 100)], "k int, c int")
    for inline in (10, 0):
        model = X.OrdinalEncode(["c"], inline=inline).fit(df)
        assert values(model.transform(df), "c") == [(1,), (0,), (2,)]


def test_fixed_list_splits_new_rows(spark):
    train = frame(spark, [(i, f"[{i}, {i + 50}]") for i in range(5)], "k int, l string")
    model = X.ListColumns(["l"], max_elements=3).fit(train)
    new = frame(spark, [(1, "[7, 8]"), (2, "[9]")], "k int, l string")
    assert values(model.transform(new), "l_0", "l_1") == [("7", "8"), ("9", None)]


def test_list_kinds(spark):
    df = frame(spark, [(1, "[a, b]"), (2, "[c]"), (3, None)], "k int, l string")
    hot = X.ListColumns(["l"]).fit(df).transform(df)
    assert hot.columns == ["k", "l_0", "l_a", "l_b", "l_c"]
    assert values(hot, "l_a", "l_0") == [(1, 0), (0, 0), (0, 1)]
    text = X.ListColumns(["l"], max_elements=2).fit(df).transform(df)
    assert text.columns == ["k", "l_as_sentence"]


def test_range_names_come_from_fit(spark):
    df = frame(spark, [(1, "5 - 9"), (2, "-3 to 4"), (3, "7"), (4, None)], "k int, r string")
    model = X.RangeNumber(["r"]).fit(df)
    assert values(model.transform(df), "r_start", "r_end") == [(5.0, 9.0), (-3.0, 4.0), (7.0, 7.0), (None, None)]
    plain = X.RangeNumber(["r"]).fit(df.filter("k = 3"))
    assert plain.transform(df).columns == ["k", "r_no_change"]


def test_formatted_id_splits_casts_and_drops(spark):
    df = frame(spark, [(1, "AB-1-x"), (2, "AB-2-y"), (3, "AB-3-z")], "k int, c string")
    model = X.FormattedId(["c"]).fit(df)
    got = model.transform(df)
    assert got.columns == ["k", "c_1", "c_2"]
    assert values(got, "c_1", "c_2") == [(1.0, "x"), (2.0, "y"), (3.0, "z")]
    given = X.FormattedId(["c"], specs={"c": {"option": 1, "offsets": [2, 4]}}).fit(df).transform(df)
    assert given.columns == ["k", "c_1", "c_2"] and values(given, "c_1")[0] == (-1.0,)


def test_split_separator_is_the_most_frequent(spark):
    df = frame(spark, [(1, "a-b-c"), (2, "d-e-f"), (3, "g/h/i")], "k int, c string")
    assert X.detect_split(df, "c") == ("-", 3)
    uneven = frame(spark, [(1, "a-b-c"), (2, "d-e")], "k int, c string")
    assert X.detect_split(uneven, "c") == (None, 1)


def test_mode_impute(spark):
    df = frame(
        spark, [(1, "b", float("inf")), (2, "a", 2.0), (3, None, 2.0), (4, None, 10.0)], "k int, s string, d double"
    )
    got = X.ModeImpute(["s", "d"]).fit(df).transform(df)
    assert values(got, "s", "d") == [("b", 2.0), ("a", 2.0), ("a", 2.0), ("a", 10.0)]
    empty = frame(spark, [(1, None)], "k int, s string")
    assert values(X.ModeImpute(["s"]).fit(empty).transform(empty), "s") == [("nothing",)]


def test_date_dialect_and_names(spark):
    df = frame(spark, [(1, "2020-05-04", "令和2年5月4日"), (2, "None", "soon")], "k int, a string, b string")
    got = X.DateParts(["a", "b"], key="k").fit(df).transform(df)
    assert values(got, "a_year", "a_weekday", "b_年", "b_日") == [(2020, 0, 2020, 4), (None, None, None, None)]


def test_interleaved_samples(spark):
    df = frame(spark, [(1, "5"), (2, "x"), (3, "6"), (4, "7"), (5, None)], "k int, c string")
    assert X.interleaved_samples(df, "c", "k").first()["samples"] == ["x", "5", "x", "6", "x"]
    only = df.filter("k < 2")
    assert X.interleaved_samples(only, "c", "k").first()["samples"] == ["5"] * 5


def test_tfidf_vector_is_normalised(spark):
    df = frame(spark, [(1, "Red red ball 12"), (2, "blue ball"), (3, None)], "k int, t string")
    rows = X.tfidf_rows(df, "t", "k").collect()
    norms = {}
    for r in rows:
        norms[r["k"]] = norms.get(r["k"], 0.0) + r["weight"] ** 2
    assert all(abs(n - 1.0) < 1e-9 for n in norms.values())
    assert {r["term"] for r in rows} == {"red", "ball", "num", "blue", "na"}


def chain(df):
    stages = [X.UnitNumber(["u"]), X.RangeNumber(["r"]), X.UrlParts(["w"]), X.CastIfNumeric(["n"])]
    return Pipeline(stages=stages).fit(df)


def messy(spark):
    return frame(
        spark,
        [(1, "5 kg", "1-2", "http://www.a.b/c/d?q", "1"), (2, "3 g", "4", None, "2.5")],
        "k int, u string, r string, w string, n string",
    )


def test_chain_saves_and_loads(spark, tmp_path):
    df = messy(spark)
    model = chain(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert again.transform(df).collect() == model.transform(df).collect()
    assert values(again.transform(df), "u", "w_Domain", "n")[0] == (5000.0, "a.b", 1.0)


def test_chain_runs_on_a_stream(spark, tmp_path):
    df = messy(spark)
    model = chain(df)
    df.write.json(str(tmp_path / "in"))
    stream = transform_stream(model, stream_table(spark, str(tmp_path / "in"), df.schema, "json"))
    run = (
        stream.writeStream.format("memory").queryName("chained")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    run.awaitTermination(60)
    got = spark.table("chained").orderBy("k").collect()
    assert got == model.transform(df).orderBy("k").collect()
    with pytest.raises(ValueError):
        transform_stream(model, df)


def test_transform_plan_has_no_shuffle(spark):
    df = messy(spark)
    plan = chain(df).transform(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_results_do_not_depend_on_partitioning(spark):
    df = frame(spark, [(i, f"{i % 7}-{i % 3}-{i}", f"{i % 5} kg") for i in range(200)], "k int, c string, u string")
    outs = []
    for n in (1, 7):
        moved = df.repartition(n)
        got = Pipeline(stages=[X.FormattedId(["c"]), X.UnitNumber(["u"]), X.OrdinalEncode(["u"])]).fit(moved).transform(moved)
        outs.append(sorted(map(tuple, got.collect())))
    assert outs[0] == outs[1]


def test_enrich_readies_every_column(spark):
    rows = [(i, f"{i % 9 + 1} kg", f"{i % 9} - {i % 9 + 4}", ("red", "blue")[i % 2]) for i in range(60)]
    df = frame(spark, rows, "k int, unit string, span string, colour string")
    done, types, model = Mo.enrich(df, {"unit": 8, "span": 10, "colour": 1}, key="k")
    assert "span" not in done.columns and {"span_start", "span_end"} <= set(done.columns)
    assert set(types.values()) <= set(Mo.READY) and types["unit"] == 0
    assert model.transform(df).columns == done.columns


def test_models_per_target_and_score(spark):
    rows = [(i, float(i % 10), ("a", "b")[i % 2], f"word{i % 2} text", i % 2) for i in range(80)]
    df = frame(spark, rows, "k int, x double, c string, t string, y int")
    types = {"x": 0, "c": 1, "t": 3}
    scored = Mo.score_candidates(df, df, [types, {"x": 0, "c": 1, "t": 7}], ["y"], "classification", "rf")
    assert [s[0] for s in scored] == [1, 2] and scored[0][2] == 1.0
    (regression,) = Mo.build_pipeline(types, ["x"], "regression", "gbt")
    assert "x_predicted" in regression.fit(df).transform(df).columns


def test_boosted_trees_tell_three_classes_apart(spark):
    rows = [(i, float(i % 3), i % 3) for i in range(60)]
    df = frame(spark, rows, "k int, x double, y int")
    ((_, _, score),) = Mo.score_candidates(df, df, [{"x": 0}], ["y"], "classification")
    assert score == 1.0


class GivenProbabilities:
    """Stands for a type classifier: two likely types for the first column."""

    def probabilities(self, profiles):
        rows = [("input", 0, 0, 0.5), ("input", 0, 8, 0.4), ("input", 1, 1, 0.9)]
        return profiles.sparkSession.createDataFrame(
            rows, "table_id string, column_id int, class int, probability double"
        )


def test_search_prefers_the_type_that_predicts(spark):
    rows = [(i, f"{i % 8 + 1} {('g', 'kg')[i % 2]}", ("u", "v")[i % 3 == 0], i % 2) for i in range(400)]
    df = frame(spark, rows, "k int, weight string, c string, y int")
    got = Mo.search_types(df, "k", ["y"], "classification", GivenProbabilities(), learner="rf")
    assert got == {"weight": 8, "c": 1}


def test_lists_that_the_first_rows_settle_are_not_counted_in_full(spark, monkeypatch):
    asked, top, one = [], X.top_per_group, X.one_row
    monkeypatch.setattr(X, "top_per_group", lambda rows, *a, **k: asked.append("elements") or top(rows, *a, **k))
    monkeypatch.setattr(X, "one_row", lambda rows, aggs: asked.append("lengths") or one(rows, aggs))
    rows = spark.range(1500).selectExpr(
        "concat('[a', id, ']') AS even", "concat('[b', id, if(id % 2 = 0, ', c', ''), ']') AS uneven", "'[x, y]' AS few",
        "concat('[k', id % 3, ']') AS late"
    )
    state = X.ListColumns(["even", "uneven", "few"], max_elements=5).fit(rows).getState()
    assert state == {"even": {"kind": "fixed", "length": 1}, "uneven": {"kind": "text"}, "few": {"kind": "categories", "values": ["x", "y"]}}
    assert asked == ["elements", "lengths"]
    asked.clear()
    assert X.ListColumns(["uneven"], max_elements=5).fit(rows).getState() == {"uneven": {"kind": "text"}}
    assert asked == []


def test_enrich_profiles_new_columns_from_files(spark, monkeypatch):
    """They are derived once, not in each pass of the profile, whatever their names."""
    rows = [(i, f"{i % 7} - {i % 7 + 5}", f"['a;{i % 3}', 'b {i % 2}']") for i in range(60)]
    df = spark.createDataFrame(rows, "k int, span string, items string")
    read, types_of = [], Mo.I.types_of

    def seen(some, *more):
        read.append((some.columns, len(some.inputFiles())))
        return types_of(some, *more)

    monkeypatch.setattr(Mo.I, "types_of", seen)
    out, types, _ = Mo.enrich(df, {"span": Mo.I.RANGE, "items": Mo.I.LIST}, key="k")
    fresh = [c for c in out.columns if c != "k"]
    assert {"span_start", "span_end"} < set(fresh) and set(types) == set(fresh)
    assert read[0][0] == ["k", *fresh] and all(files > 0 for _, files in read)
