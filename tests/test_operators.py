import math

import numpy as np
from pyspark.sql import functions as F

from tablewright.operators import answers as A
from tablewright.operators import describe as D
from tablewright.operators import evaluate as E
from tablewright.operators import infer as I
from tablewright.operators import licences as L
from tablewright.operators import lineage as G
from tablewright.operators import profile as P
from tablewright.operators import sampling as M
from tablewright.operators import transforms as X
from tablewright.operators.pages import main_text
from tablewright.operators.ranking import ordered_prefix, top_per_group


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_profile_ignores_nan_and_infinity(spark):
    df = frame(spark, [(1, 1.0, "a"), (2, float("nan"), None), (3, float("inf"), "b"), (4, 3.0, "a")], "k int, d double, s string")
    got = {r["column"]: r for r in P.profile(df, "k").collect()}
    d = got["d"]
    assert (d["total_vals"], d["num_nans"], d["num_of_dist_val"]) == (4, 2, 2)
    assert (d["mean"], d["std_dev"], d["min_val"], d["max_val"]) == (2.0, 1.0, 1.0, 3.0)
    assert d["samples"] == ["1.0", "3.0", "1.0", "3.0", "1.0"]
    assert not d["has_date"]


def test_profile_of_an_empty_column(spark):
    df = frame(spark, [(1, None), (2, None)], "k int, s string")
    got = {r["column"]: r for r in P.profile(df, "k").collect()}["s"]
    assert got["samples"] == ["NaN"] * 5 and got["num_of_dist_val"] == 0 and not got["has_date"]


def test_long_texts_keep_their_whole_value(spark):
    long = "x" * 500
    df = frame(spark, [(1, long + "1"), (2, "short"), (3, long + "2"), (4, long + "1")], "k int, s string")
    counts = P.value_counts(df, "k", ["s"])
    assert counts.agg(F.max(F.length("token"))).first()[0] < 130
    assert P.column_samples(df, "k", columns=["s"]).first()["samples"][:3] == [long + "1", "short", long + "2"]


def test_delimiters_are_counted_themselves(spark):
    df = frame(spark, [(1, "a,b;c d")], "k int, s string")
    got = P.sample_shape(P.column_samples(df, "k", columns=["s"])).first()
    assert got["mean_delim_count"] == 2.0 and got["mean_whitespace_count"] == 1.0


def test_profile_does_not_depend_on_partitioning(spark):
    df = frame(spark, [(i, i % 13, f"v{i % 17}") for i in range(300)], "k int, n int, s string")
    results = [
        P.profile(df.repartition(n), "k").withColumn("std_dev", F.round("std_dev", 9)).orderBy("pos").collect()
        for n in (1, 7)
    ]
    assert results[0] == results[1]


def test_approximate_counts_take_one_pass(spark):
    df = frame(spark, [(i, i % 13) for i in range(300)], "k int, n int")
    stats = P.column_stats(df, approx=True)
    assert stats._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {r["column"]: r["num_of_dist_val"] for r in stats.collect()}["n"] == 13


def test_rule_types(spark):
    rows = [
        (i, f"{i} kg", f"{i} - {i + 3}", f"http://a.b/{i}", f"AB-{i}-{i % 4}", f"2020-01-{i % 28 + 1:02d}", i * 1.5, "same", f"n{i} words here and there in a long line of text for it")
        for i in range(1, 60)
    ]
    names = "k int, unit string, span string, url string, code string, day string, num double, one string, prose string"
    got = I.types_of(frame(spark, rows, names), "k")
    assert got == {"k": 0, "unit": 8, "span": 10, "url": 4, "code": 11, "day": 2, "num": 0, "one": 1, "prose": 3}


def test_mixed_column_shows_text_cells(spark):
    df = frame(spark, [(1, "1"), (2, "n/a"), (3, "2"), (4, "n/a")], "k int, s string")
    got = P.mixed_columns(df, "k", ["s"]).first()
    assert got["is_mixed"] and got["override"] == ["n/a", "n/a"] and got["number_share"] == 0.5


def brute_candidates(columns, n):
    best = [(0.0, [])]
    for classes in columns:
        kept = [(c, p) for c, p in enumerate(classes) if p > 1 / len(classes)]
        best = [(s + p, t + [c]) for s, t in best for c, p in kept]
    return [t for s, t in sorted(best, key=lambda b: (-b[0], b[1]))[:n]]


def test_top_candidates_match_the_full_product(spark):
    columns = [[0.5, 0.375, 0.125], [0.4375, 0.375, 0.1875], [0.75, 0.125, 0.125], [0.34375, 0.34375, 0.3125]]
    rows = [(1, i, c, p) for i, ps in enumerate(columns) for c, p in enumerate(ps)]
    df = frame(spark, rows, "table_id int, column_id int, class int, probability double")
    got = [r["types"] for r in I.type_candidates(df, 6).orderBy("rank").collect()]
    assert got == brute_candidates(columns, 6)


def test_best_candidate_prefers_special_types_on_ties(spark):
    df = frame(spark, [(1, 1, [0, 1], 0.9), (1, 2, [0, 8], 0.9), (1, 3, [6, 8], 0.9), (1, 4, [4], 0.1)], "table_id int, rank int, types array<int>, score double")
    assert I.best_candidate(df).first()["rank"] == 2


def test_doane_bins_match_the_formula(spark):
    values = [1.0, 2.0, 2.5, 3.0, 10.0, 4.0, 4.5, 2.2]
    n, mean = len(values), sum(values) / len(values)
    sd = math.sqrt(sum((v - mean) ** 2 for v in values) / n)
    skew = sum((v - mean) ** 3 for v in values) / n / sd**3
    error = math.sqrt(6 * (n - 2) / ((n + 1) * (n + 3)))
    want = math.ceil(1 + math.log2(n) + math.log2(1 + abs(skew) / error))
    df = frame(spark, [(v,) for v in values], "x double")
    assert M.doane_bins(df, "x").first()["bins"] == want
    placed = A.histogram(df, "x").agg(F.sum("n")).first()[0]
    assert placed == n  # the edges count once


def test_split_is_stable_and_three_way(spark):
    df = spark.range(4000).withColumnRenamed("id", "k")
    parts = [M.hash_split(df.repartition(n), "k") for n in (1, 7)]
    assert sorted(map(tuple, parts[0].collect())) == sorted(map(tuple, parts[1].collect()))
    shares = {r["split"]: r["count"] / 4000 for r in parts[0].groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.6) < 0.05 and abs(shares["validation"] - 0.15) < 0.05


def test_hot_group_is_cut_before_the_last_ranking(spark):
    rows = [(0 if i % 3 else i, i) for i in range(3000)]
    df = frame(spark, rows, "g int, k int")
    plain = top_per_group(df, ["g"], [F.col("k")], 10)
    spread = top_per_group(df, ["g"], [F.col("k")], 10, spread=["k"])
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, spread.collect()))
    assert "WindowGroupLimit" in spread._jdf.queryExecution().executedPlan().toString()


def test_ordered_prefix_matches_a_running_sum(spark):
    rows = [("a" if i % 3 else "b", (i * 37) % 501, i % 5) for i in range(501)]
    df = frame(spark, rows, "g string, v int, w int")
    got = {(r["g"], r["v"]): r["upto"] for r in ordered_prefix(df, ["v"], ["g"], "w").collect()}
    for g in "ab":
        total = 0
        for _, v, w in sorted(r for r in rows if r[0] == g):
            total += w
            assert got[(g, v)] == total


def test_five_numbers(spark):
    rows = [(i % 3, float((i * 7919) % 1000)) for i in range(1000)] + [(9, 4.0)]
    df = frame(spark, rows, "g int, v double")
    got = {r["g"]: tuple(r)[1:] for r in A.five_numbers(df, ["g"], "v").collect()}
    want = df.groupBy("g").agg(F.percentile("v", F.lit([0.0, 0.25, 0.5, 0.75, 1.0])).alias("p")).collect()
    for r in want:
        assert [round(x, 9) for x in got[r["g"]]] == [round(x, 9) for x in r["p"]]


def test_main_text_drops_what_a_host_repeats(spark):
    pages = [(i, f"http://h.x/{i}", f"<ul><li>Menu</li></ul><script>var a='<p>';</script><p>Body {i}</p>") for i in range(6)]
    pages += [(9, "http://solo.x/", "<p>Menu</p>"), (10, "http://h.x/e", "")]
    df = frame(spark, pages, "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in main_text(df).collect()}
    assert got[0] == "Body 0" and got[9] == "Menu" and got[10] == ""


def test_best_match_and_votes(spark):
    pairs = frame(spark, [(1, 7, 0.5), (1, 3, 0.5), (1, 9, 0.1), (2, 4, 0.0)], "gt_id int, pred_id int, score double")
    assert sorted(map(tuple, E.best_match(pairs).collect())) == [(1, 3, 0.5), (2, 4, 0.0)]
    votes = frame(spark, [(1, "Same"), (1, "Same"), (1, "Same"), (1, None), (2, "Same"), (2, "oops")], "id int, verdict string")
    assert {r["id"]: r["match"] for r in E.majority(votes, ["id"]).collect()} == {1: True, 2: False}


def test_matching_without_partner(spark):
    gold = frame(spark, [(1, 1, "a b"), (1, 2, "c")], "d int, gt_id int, gt_text string")
    pred = frame(spark, [(1, 1, "a"), (1, 2, "c")], "d int, pred_index int, pred_text string")
    matching = frame(spark, [(1, 1, 1), (1, 2, -1)], "d int, gt_id int, pred_index int")
    zero = E.score_matching(gold, pred, matching, E.token_jaccard, ["d"], unmatched="zero")
    assert {r["gt_id"]: r["score"] for r in zero.collect()} == {1: 0.5, 2: 0.0}
    hashed = E.score_matching(gold, pred, matching, E.token_jaccard, ["d"])
    assert hashed.count() == 2 and hashed.filter("pred_index between 1 and 2").count() == 2


def test_duplicate_questions_count_by_turn(spark):
    gold = frame(spark, [(1, 0, "x"), (1, 1, "x")], "q int, turn int, target string")
    pred = frame(spark, [(1, 0, "x"), (1, 1, "y")], "q int, turn int, pred string")
    row = E.qa_accuracy(E.match_turns(pred, gold, ["q", "turn"]), ["q"]).first()
    assert (row["turns"], row["single_accuracy"], row["multi_accuracy"]) == (2, 0.5, 0.0)


def test_licence_order_of_rules(spark):
    texts = [None, "", "<MISSING>", "CC-BY-NC-SA-9", "X-SA-1", "CalHHS Terms of Use v2", "other", "us-pd"]
    df = frame(spark, [(t,) for t in texts], "license string")
    got = [r[0] for r in df.select(L.license_category(F.col("license"))).collect()]
    assert got == ["problem"] * 3 + ["noncommercial", "sharealike", "attribution", "review", "ok"]
    assert L.by_category(df).count() == 6


def test_lineage_bare_nodes_and_undirected_edges(spark):
    qa = frame(spark, [("Q_1_0", "q", "a", ["I_0_0"])], "id string, question string, answer string, refs array<string>")
    ins = frame(spark, [("I_0_0", "found", ["Q_1_0", "Q_0_5"])], "id string, insight string, refs array<string>")
    nodes = {r["id"]: r["type"] for r in G.lineage_nodes(qa, ins).collect()}
    assert nodes == {"Q_1_0": "QA", "I_0_0": "insight", "Q_0_5": None}
    assert sorted(map(tuple, G.lineage_edges(qa, ins).collect())) == [("I_0_0", "Q_0_5"), ("I_0_0", "Q_1_0")]


def test_description_text(spark):
    df = frame(spark, [(i, ("x", "y")[i % 2], None if i == 3 else 1.5 * i) for i in range(300)], "k int, c string, d double")
    text = D.describe_text(D.describe_table(df, {"k": 7, "c": 1, "d": 0}, "k")).first()["text"]
    assert "Number of rows: 300" in text and "All categories are [x, y]." in text
    assert "d (feature type: Numerical) (value type: floating) (ratio of missing values: 1%)" in text
    assert D.sidecar_text(df.select("k", "c"), "k", ["c"]).first()["text"].startswith("Number of columns")
    assert D.sidecar_text(df.limit(9), "k", ["c"]).first()["text"] == "c\nx\ny"


def test_transcript_parts_stay_bounded(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(12)]
    df = frame(spark, rows, "conv int, turn long, role string, text string")
    got = D.transcript(df, "conv", "turn", per_part=5).orderBy("part").collect()
    assert len(got) == 3 and got[0]["text"].startswith("Q: t0\nA: t1\n")
    assert D.questions(df, "conv", "turn", 500).first()["text"] == "t0\nt2\nt4\nt6\nt8\nt10"


def test_share_and_heatmap(spark):
    df = frame(spark, [("a", "p", 1.0), ("a", "q", 3.0), ("b", "p", 2.0)], "x string, l string, y double")
    shares = {(r["x"], r["legend"]): r["share"] for r in A.share(df, F.col("x"), F.sum("y"), F.col("l")).collect()}
    assert shares == {("a", "p"): 0.25, ("a", "q"): 0.75, ("b", "p"): 1.0}
    assert A.heatmap(df, "x", "l", F.sum("y"), ["p", "q"]).columns == ["x", "p", "q"]


def test_first_rows_decide_samples_exactly(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(P, "FIRST_ROWS", 12)
    long = "a" * P.LONG_TEXT
    rows = [
        (None if k == 0 and null else int(k), int(a), None if rng.random() < 0.9 else int(a), f"{long}{a}", "one")
        for null in (False, True) for k, a in zip(rng.integers(0, 25, 60), rng.integers(0, 30, 60))
    ]
    schema = "k long, many long, sparse long, texts string, one string"
    columns = ["many", "sparse", "texts", "one", "k"]
    for some, key in ((rows, "k"), (rows[:60], "k"), (rows, ["k", "many"]), (rows[:5], "k"), ([], "k")):
        df = spark.createDataFrame(some, schema).repartition(3)
        whole = P.column_samples(df, key, columns=columns, counts=P.value_counts(df, key, columns))
        assert sorted(P.column_samples(df, key, columns=columns).collect()) == sorted(whole.collect())


def test_columns_settled_by_first_rows_are_not_counted_in_full(spark, monkeypatch):
    asked = []
    counts = P.value_counts
    monkeypatch.setattr(P, "value_counts", lambda df, key=None, columns=None: asked.append(list(columns)) or counts(df, key, columns))
    df = spark.range(2000).selectExpr("id", "cast(id % 2 AS string) AS two", "concat('x', id) AS texts")
    P.column_samples(df, "id", columns=["id", "two", "texts"]).collect()
    assert asked == [["id", "two", "texts"], ["two"]]


def test_a_type_profile_writes_no_distinct_values(spark, monkeypatch):
    written = []

    def counted(write):
        def durable(df):
            out = write(df)
            written.append(out.count())
            return out

        return durable

    for module in (I, P, X):
        monkeypatch.setattr(module, "durable", counted(module.durable))
    rows = [(i, i / 7, f"A{i}-{i % 10}-B", "x" if i % 3 else "y", f"{i}" if i % 2 else f"{i} kg") for i in range(3000)]
    df = frame(spark, rows, "k int, d double, code string, few string, mixed string")
    got = {r["column"]: r for r in I.type_profile(df, "k").collect()}
    # the values of the first rows by column, not those of the table
    assert max(written) <= P.FIRST_ROWS * len(df.columns) < df.count()
    assert [got[c]["num_of_dist_val"] for c in ("d", "code", "few", "mixed")] == [3000, 3000, 2, 3000]
    assert [got[c]["category_size"] for c in ("d", "code", "few", "mixed")] == ["none", "none", "binary", "none"]
    assert got["code"]["parts"] == 3 and got["few"]["parts"] == 1
    assert got["code"]["samples"][:2] == ["A0-0-B", "A1-1-B"] and got["mixed"]["samples"][:2] == ["0 kg", "2 kg"]


def test_category_size_covers_the_twenty_most_frequent_values(spark):
    # 19 values of 30 rows, three of 10 and many of 1: the top 20 hold 19 * 30 + 10 rows
    for single, want in ((100, "large"), (140, "none")):
        values = [f"a{i}" for i in range(19) for _ in range(30)] + [f"b{i}" for i in range(3) for _ in range(10)]
        values += [f"c{i}" for i in range(single)]
        df = frame(spark, [(v,) for v in values], "s string")
        assert P.category_size(df).first()["category_size"] == want
        assert (580 / len(values) > 0.8) == (want == "large")


def test_columns_whose_first_rows_differ_in_parts_are_not_split(spark):
    rows = [("1-2-3", "1-2-3", None, "ab")] * 300 + [("1-2-3", "1-2-3-4", "4-5-6", "ab")] * 100
    df = frame(spark, rows, "same string, late string, gap string, one string").coalesce(1)
    assert X.maybe_split(df, df.columns) == ["same", "late", "gap"]
    # what the first rows leave open, all rows settle
    found = {r["column"]: r["parts"] for r in X.detect_splits(df, df.columns).collect()}
    assert found == {"same": 3, "late": 1, "gap": 3, "one": 1}


def test_number_shares_by_kind_of_column(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, 1.5D, 2.50, true, DATE'2020-01-01', '7', array(1)), (2, double('nan'), null, false, null, 'x', null)"
        " t(i, d, m, b, t, s, a)"
    )
    got = {r["column"]: r["number_share"] for r in P.number_shares(df).collect()}
    assert got == {"i": 1.0, "d": 1.0, "m": 1.0, "b": 0.0, "t": 0.0, "s": 0.5, "a": 0.0}
