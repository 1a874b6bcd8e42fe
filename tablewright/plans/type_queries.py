"""Queries over type inference, its models, and model building."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.functions.parts import ABOVE_WORDS, BELOW_WORDS, UNIT_FACTORS
from tablewright.operators import infer as I
from tablewright.operators import modelling as Mo
from tablewright.operators import profile as P
from tablewright.operators import sampling as M
from tablewright.operators import type_model as T
from tablewright.operators.boosting import BoostedTrees
from tablewright.plans.profile_queries import (
    KIND,
    NUMBER_SQL,
    SAMPLED,
    arms,
    load,
    per_table,
    samples_cte,
    shape_cte,
    shares_cte,
    with_used,
)
from tablewright.operators.principal import principal_components, project
from tablewright.plans.registry import query, table
from tablewright.plans.transform_queries import UNIT_CASE, _split_arm, digits, quoted
from tablewright.plans.views import view, with_views
from tablewright.session import durable, fresh_path

TYPED = {
    "orders": ("o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
    "customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "dv_part": ("p_partkey", [
        "p_partkey", "p_size", "p_type", "const_text", "unit_text", "sign_text", "range_text", "embed_text",
        "list_text", "code_text", "mixed_text", "type_nullable", "size_nullable",
    ]),
    "dv_dates": ("o_orderkey", ["o_orderdate", "iso_text", "era_text"]),
    "pages": ("page_id", ["page_id", "url", "html"]),
    "documents": ("doc_id", ["text", "lang", "source"]),
}
KIND.update({"page_id": "integer"})


def lower_digits(v):
    return f"regexp_replace(lower({v}), '\\d+', 'num', 'g')"


@query(
    "t1_normalize_text",
    with_used(SAMPLED, samples_cte(SAMPLED))
    + f"SELECT table_name, {lower_digits('cname')} AS name_text, {lower_digits('s[1]')} AS cell_1, {lower_digits('s[2]')} AS cell_2 FROM samples",
)
def t1_normalize_text(spark, sf_dir):
    return per_table(
        spark, sf_dir, SAMPLED,
        lambda df, key, cols: P.column_samples(df, key, columns=cols).select(
            I.normalize_text(F.col("column"), default="column").alias("name_text"),
            I.normalize_text(F.col("samples")[0]).alias("cell_1"),
            I.normalize_text(F.col("samples")[1]).alias("cell_2"),
        ),
    )


@query(
    "t6_drop_degenerate",
    with_used(TYPED, " x AS (SELECT 1)") + "SELECT table_name, column_name FROM (" + arms(
        TYPED,
        """SELECT '{t}' AS table_name, '{c}' AS column_name, coalesce(avg({x}), 0) AS a, coalesce(stddev_pop({x}), 0) AS b, coalesce(min({x}), 0) AS c, coalesce(max({x}), 0) AS d FROM {t}""",
    ) + ") WHERE NOT (a = 0 AND b = 0 AND c = 0 AND d = 0)",
)
def t6_drop_degenerate(spark, sf_dir):
    def build(df, key, cols):
        stats = P._moments(df, [df.schema[c] for c in cols], False)
        labelled = stats.withColumn("subcategory", F.lit("numeric"))
        return I.drop_degenerate(labelled).select(F.col("column").alias("column_name"))

    return per_table(spark, sf_dir, TYPED, build)


@query(
    "t12_single_value",
    with_used(TYPED, " x AS (SELECT 1)") + arms(
        TYPED,
        "SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(CASE WHEN count(DISTINCT {c}) = 1 THEN 1 ELSE 3 END AS INTEGER) AS type FROM {t}",
    ),
)
def t12_single_value(spark, sf_dir):
    return per_table(
        spark, sf_dir, TYPED,
        lambda df, key, cols: P.column_stats(df, cols).select(
            F.col("column").alias("column_name"),
            I.single_value_override(F.lit(I.SENTENCE), F.col("num_of_dist_val")).alias("type"),
        ),
    )


def _type_sql() -> str:
    texts = [(t, c) for t, (_, cols) in TYPED.items() for c in cols if KIND.get(c, "string") == "string"]
    split = "splits AS (" + "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, column_name AS cname, parts FROM ("
        + _split_arm(c).replace("dv_part", f"(SELECT * FROM {t} WHERE {c} IS NOT NULL)") + ")"
        for t, c in texts
    ) + ")"
    stats = "stats AS (" + arms(
        TYPED,
        "SELECT '{t}' AS table_name, '{c}' AS cname, {num} AS is_num, count(*) AS total, count(DISTINCT {c}) AS dist FROM {t}",
    ) + ")"
    sizes = "sizes AS (" + arms(
        TYPED,
        """SELECT '{t}' AS table_name, '{c}' AS cname, CASE WHEN count(*) <= 2 THEN 'binary'
  WHEN count(*) <= 20 AND count(*) / sum(n) < 0.3 THEN 'small'
  WHEN sum(n) FILTER (WHERE r <= 20) / sum(n) > 0.8 THEN 'large' ELSE 'none' END AS size
  FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS r FROM (SELECT count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}))""",
    ) + ")"
    words = "words AS (" + arms(
        TYPED,
        """SELECT '{t}' AS table_name, '{c}' AS cname, list(v ORDER BY k) AS w FROM (
  SELECT CAST({c} AS VARCHAR) AS v, {k} AS k FROM {t} WHERE '{dt}' = 'string' AND {c} IS NOT NULL AND NOT """
        + NUMBER_SQL.replace("{v}", "CAST(@c@ AS VARCHAR)").replace("{", "{{").replace("}", "}}").replace("@c@", "{c}")
        + " ORDER BY k LIMIT 5)",
    ) + ")"
    # Text cells of a mixed column stand in for its first samples.
    base = samples_cte(TYPED).replace("samples AS (SELECT", "plain AS (SELECT")
    mixed = """samples AS (SELECT p.table_name, p.cname, p.dtype, has_values,
  CASE WHEN share > 0 AND share < 1 THEN list_transform(range(1, 6), lambda i: coalesce(w[i], s[i])) ELSE s END AS s
  FROM plain p JOIN shares h ON h.table_name = p.table_name AND h.column_name = p.cname
  LEFT JOIN words w ON w.table_name = p.table_name AND w.cname = p.cname)"""

    def most(test):
        return f"len(list_filter(s, lambda v: {test})) > 2"

    sign = r"lower(trim(regexp_replace(v, '\d+(\.\d+)?', '', 'g')))"
    unit = "trim(regexp_replace(v, '[0-9.]+', '', 'g'))"
    number = r"regexp_matches(v, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$')"
    rules = f"""CASE WHEN dist <= 1 THEN 1
  WHEN dtype = 'integer' AND dist = total AND regexp_matches(lower(cname), '(key|id)$') THEN 7
  WHEN is_num AND size IN ('binary', 'small') THEN 1 WHEN is_num THEN 0
  WHEN dtype = 'datetime' THEN 2 WHEN has_url THEN 4 WHEN has_date THEN 2
  WHEN {most(r"regexp_matches(v, '^\s*[[].*[]]\s*$')")} OR is_list THEN 6
  WHEN {most(r"regexp_matches(v, '^\s*-?\d*\.?\d+\s*(-|:|to|~|～|から)\s*-?\d*\.?\d+\s*$')")} THEN 10
  WHEN {most(rf"regexp_matches(v, '\d') AND {sign} IN ({quoted(BELOW_WORDS + ABOVE_WORDS)})")} THEN 9
  WHEN {most(rf"regexp_matches(v, '\d') AND {unit} IN ({quoted(UNIT_FACTORS)})")} THEN 8
  WHEN parts > 1 AND mean_word_count <= 10 THEN 11
  WHEN {most(rf"len(regexp_extract_all(v, '\d+(\.\d+)?')) = 1 AND NOT {number} AND len(string_split(v, ' ')) <= 3")} THEN 5
  WHEN is_long_sentence THEN 3 WHEN {most(number)} THEN 0 WHEN size <> 'none' THEN 1 WHEN dist = total THEN 7 ELSE 3 END"""
    return (
        with_used(TYPED, stats, sizes, split, shares_cte(TYPED), words, base, mixed, shape_cte())
        + f" SELECT table_name, cname AS column_name, CAST({rules} AS INTEGER) AS type FROM flagged JOIN stats USING (table_name, cname)"
        + " JOIN sizes USING (table_name, cname) LEFT JOIN splits USING (table_name, cname)"
    )


@query("t14_rule_types", _type_sql())
def t14_rule_types(spark, sf_dir):
    return per_table(
        spark, sf_dir, TYPED,
        lambda df, key, cols: I.infer_types(df, key, cols).select(F.col("column").alias("column_name"), "type"),
    )


KEPT_SQL = """, placed AS (SELECT table_id, column_id, class, probability, dense_rank() OVER (PARTITION BY table_id ORDER BY column_id) AS pos,
  count(*) OVER (PARTITION BY table_id, column_id) AS k FROM dv_proba),
kept AS (SELECT * FROM placed WHERE probability > 1.0 / k)"""


@query("t9_candidate_classes", with_views("dv_proba") + KEPT_SQL + " SELECT table_id, column_id, class, probability FROM kept")
def t9_candidate_classes(spark, sf_dir):
    kept = I.candidate_classes(view(spark, sf_dir, "dv_proba"))
    return kept.select("table_id", "column_id", F.inline("classes"))


@query(
    "t10_top_candidates",
    with_views("dv_proba").replace("WITH ", "WITH RECURSIVE ", 1) + KEPT_SQL
    + """, grown AS (SELECT table_id, pos, [class] AS types, probability AS score FROM kept WHERE pos = 1
  UNION ALL SELECT g.table_id, k.pos, list_append(g.types, k.class), g.score + k.probability FROM grown g JOIN kept k ON k.table_id = g.table_id AND k.pos = g.pos + 1),
last AS (SELECT table_id, max(pos) AS pos FROM placed GROUP BY table_id)
SELECT table_id, CAST(rank AS INTEGER) AS rank, array_to_string(types, ',') AS types, score FROM (
  SELECT table_id, types, score, row_number() OVER (PARTITION BY table_id ORDER BY score DESC, types) AS rank FROM grown JOIN last USING (table_id, pos)) WHERE rank <= 50""",
)
def t10_top_candidates(spark, sf_dir):
    found = I.type_candidates(view(spark, sf_dir, "dv_proba"))
    return found.withColumn("types", F.array_join(F.col("types").cast("array<string>"), ","))


@query(
    "t11_classification_report",
    "SELECT quality, toxic, count(*) AS n, (SELECT round(avg(CAST(quality = toxic AS INT)), 6) FROM labels) AS accuracy FROM labels GROUP BY ALL",
)
def t11_classification_report(spark, sf_dir):
    found = I.classification_report(table(spark, sf_dir, "labels"), "quality", "toxic")
    return found.withColumn("accuracy", F.round("accuracy", 6))


@query(
    "m7_score_classes",
    "SELECT round(avg(CAST(quality = 1 AND toxic = 0 AS INT)), 6) AS score FROM labels",
)
def m7_score_classes(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumns({"q": F.lit(1), "t": F.lit(0)})
    found = Mo.score(rows, ["quality", "toxic"], ["q", "t"], "classification")
    return found.select(F.round("score", 6).alias("score"))


@query(
    "m7_score_regression",
    "SELECT round(1 - sum(pow(l_extendedprice - l_quantity * 1500, 2)) / (var_pop(l_extendedprice) * count(*)), 6) AS score FROM lineitem",
)
def m7_score_regression(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("guess", F.col("l_quantity") * 1500)
    found = Mo.score(rows, ["l_extendedprice"], ["guess"], "regression")
    return found.select(F.round("score", 6).alias("score"))


@query(
    "m8_best_candidate",
    """WITH c AS (SELECT l_orderkey AS table_id, l_partkey AS rank, l_linenumber AS a, CAST(l_suppkey % 12 AS INTEGER) AS b, l_quantity % 3 AS score FROM lineitem)
SELECT table_id, rank, CAST(a AS VARCHAR) || ',' || CAST(b AS VARCHAR) AS types, score FROM (
  SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY score DESC, (a IN (4, 5, 6, 8, 9, 10, 11) OR b IN (4, 5, 6, 8, 9, 10, 11)) DESC, rank, a DESC, b DESC) AS r FROM c) WHERE r = 1""",
)
def m8_best_candidate(spark, sf_dir):
    scored = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("table_id"),
        F.col("l_partkey").alias("rank"),
        F.array("l_linenumber", (F.col("l_suppkey") % 12).cast("int")).alias("types"),
        (F.col("l_quantity") % 3).alias("score"),
    )
    found = I.best_candidate(scored)
    return found.withColumn("types", F.array_join(F.col("types").cast("array<string>"), ","))


# --- models: no SQL states their result ---------------------------------------


def labelled_profiles(spark, sf_dir):
    """Profiles of all typed tables' columns, labelled by the type rules.

    The profiles are a row per column; a session writes them once for all queries.
    The tables do not depend on each other: their jobs are submitted side by side, so
    that the cores are not idle while one table's next step is planned.
    """
    known = (spark.sparkContext.applicationId, sf_dir)
    if known in _PROFILES:
        return _PROFILES[known]

    def one(name):
        key, columns = TYPED[name]
        df = load(spark, sf_dir, name).select(*dict.fromkeys([key, *columns]))
        typed = I.type_profile(df, key, columns).withColumn("type", I.rule_type(F.col("parts")).cast("int"))
        return durable(typed.select(F.lit(name).alias("table"), "*"))

    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
        found = list(pool.map(inheritable_thread_target(spark)(one), TYPED))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    labels = F.create_map(*[F.lit(x) for pair in I.LABELS.items() for x in pair])
    _PROFILES[known] = durable(out.withColumn("subcategory", F.try_element_at(labels, F.col("type"))))
    return _PROFILES[known]


_PROFILES: dict = {}
#: Tables whose jobs are submitted side by side.
TABLES_AT_ONCE = 3


def _vector_rows(features, name):
    return features.select("table", F.col("column").alias("column_name"), F.col(name).cast("string").alias("vector"))


@query("t2_text_vectors")
def t2_text_vectors(spark, sf_dir):
    profiles = labelled_profiles(spark, sf_dir)
    return _vector_rows(T.TypeFeatures(2).fit(profiles).transform(profiles), "text_vec")


@query("t3_text_pca")
def t3_text_pca(spark, sf_dir):
    profiles = labelled_profiles(spark, sf_dir)
    return _vector_rows(T.TypeFeatures(1).fit(profiles).transform(profiles), "text_pca")


@query("t4_stage1_features")
def t4_stage1_features(spark, sf_dir):
    profiles = labelled_profiles(spark, sf_dir)
    return _vector_rows(T.TypeFeatures(1).fit(profiles).transform(profiles), "features")


@query("t5_stage2_features")
def t5_stage2_features(spark, sf_dir):
    profiles = labelled_profiles(spark, sf_dir)
    return _vector_rows(T.TypeFeatures(2).fit(profiles).transform(profiles), "features")


@query("t7_train_types")
def t7_train_types(spark, sf_dir):
    profiles = labelled_profiles(spark, sf_dir)
    found = T.TypeClassifier().fit(profiles).transform(profiles)
    return I.classification_report(found.withColumnRenamed("type", "predicted").withColumn("actual", I.type_name(F.col("predicted"))), "subcategory", "actual").select("subcategory", "actual", "n")


@query("t8_predict_types")
def t8_predict_types(spark, sf_dir):
    profiles = labelled_profiles(spark, sf_dir)
    found = T.TypeClassifier().fit(profiles).transform(profiles.drop("type"))
    return found.select("table", F.col("column").alias("column_name"), "subcategory", "type")


@query("t13_saved_model")
def t13_saved_model(spark, sf_dir):
    profiles = labelled_profiles(spark, sf_dir)
    path = fresh_path(spark, "types")
    fitted = T.TypeClassifier(trees=10).fit(profiles)
    fitted.save(path)
    model = T.TypeClassifierModel.load(spark, path)
    likeliest = model.transform(profiles).select(
        F.col("table").alias("table_id"), F.col("pos").alias("column_id"), F.col("type").alias("class")
    )
    return I.type_candidates(model.probabilities(profiles), filtered=True, fallback=likeliest).select(
        "table_id", "rank", F.array_join(F.col("types").cast("array<string>"), ",").alias("types"),
        F.round("score", 4).alias("score"),
    )


ENRICHED = ["unit_text", "sign_text", "range_text", "embed_text", "list_text", "code_text", "p_size"]


@query("m5_enrich")
def m5_enrich(spark, sf_dir):
    df = view(spark, sf_dir, "dv_part").select("p_partkey", *ENRICHED)
    types = I.types_of(df, "p_partkey", ENRICHED)
    return Mo.enrich(df, types, key="p_partkey")[0]


@query("m6_model_pipeline")
def m6_model_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = M.hash_split(docs.select("doc_id", "text", "lang", "source", "n_chars", "quality"), "doc_id")
    types = {"text": 3, "lang": 1, "source": 1, "n_chars": 0}
    train = rows.filter(F.col("split") == "train").drop("split")
    (pipeline,) = Mo.build_pipeline(types, ["quality"], "classification", learner="rf")
    model = pipeline.fit(train)
    return model.transform(rows).select("doc_id", "split", "quality_index", "quality_predicted")


# --- what SQL can state of them -----------------------------------------------

LISTED = [(t, c) for t, (_, columns) in TYPED.items() for c in columns]
LISTED_SQL = "(VALUES " + ", ".join(f"('{t}', '{c}')" for t, c in LISTED) + ") l(table_name, column_name)"


def _named(features):
    return features.withColumnRenamed("table", "table_name").withColumnRenamed("column", "column_name")


def _filled(column):
    return F.aggregate(vector_to_array(column), F.lit(0.0), lambda s, x: s + x)


@query(
    "t2_name_terms",
    rf"SELECT table_name, column_name, CAST(len(regexp_extract_all({lower_digits('column_name')}, '\w\w+')) AS DOUBLE) AS name_terms FROM {LISTED_SQL}",
)
def t2_name_terms(spark, sf_dir):
    profiles = labelled_profiles(spark, sf_dir)
    found = _named(T.TypeFeatures(2).fit(profiles).transform(profiles))
    return found.select("table_name", "column_name", _filled("name_vec").alias("name_terms"))


@query("t3_components", f"SELECT table_name, column_name, CAST({T.TEXT_DIMENSIONS} AS INTEGER) AS components, true AS finite FROM {LISTED_SQL}")
def t3_components(spark, sf_dir):
    profiles = labelled_profiles(spark, sf_dir)
    found = _named(T.TypeFeatures(1).fit(profiles).transform(profiles)).withColumn("p", vector_to_array("text_pca"))
    return found.select(
        "table_name", "column_name", F.size("p").alias("components"), F.forall("p", lambda x: ~F.isnan(x)).alias("finite")
    )


# two columns of parts as places: covariances have eigenvalues and directions in closed form
MOMENTS_SQL = """m AS (SELECT var_samp(p_size) AS a, covar_samp(p_size, p_retailprice / 10) AS b, var_samp(p_retailprice / 10) AS c FROM part),
e AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l1, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS l2 FROM m)"""


def part_entries(spark, sf_dir):
    pairs = F.array(
        F.struct(F.lit(0).alias("at"), F.col("p_size").cast("double").alias("value")),
        F.struct(F.lit(1).alias("at"), (F.col("p_retailprice") / 10).alias("value")),
    )
    parts = table(spark, sf_dir, "part")
    entries = parts.select(F.col("p_partkey").alias("row"), F.explode(pairs).alias("p")).select("row", "p.at", "p.value")
    return entries, principal_components(entries, parts.count(), 2)


@query(
    "t3_variances",
    f"""WITH {MOMENTS_SQL} SELECT CAST(1 AS INTEGER) AS component, round(l1, 4) AS variance, round(a + c, 4) AS total FROM e
UNION ALL SELECT 2, round(l2, 4), round(a + c, 4) FROM e""",
)
def t3_variances(spark, sf_dir):
    _, found = part_entries(spark, sf_dir)
    rows = [(i, v, found.total) for i, v in enumerate(found.variance, 1)]
    made = spark.createDataFrame(rows, "component int, variance double, total double")
    return made.select("component", F.round("variance", 4).alias("variance"), F.round("total", 4).alias("total"))


@query(
    "t3_scores",
    f"""WITH {MOMENTS_SQL}, d AS (SELECT b / sqrt(b * b + (l1 - a) * (l1 - a)) AS x, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS y FROM e),
s AS (SELECT x * CASE WHEN (CASE WHEN abs(x) > abs(y) THEN x ELSE y END) < 0 THEN -1 ELSE 1 END AS x, y * CASE WHEN (CASE WHEN abs(x) > abs(y) THEN x ELSE y END) < 0 THEN -1 ELSE 1 END AS y FROM d)
SELECT p_partkey, round(p_size * x + p_retailprice / 10 * y, 3) AS score FROM part, s""",
)
def t3_scores(spark, sf_dir):
    entries, found = part_entries(spark, sf_dir)
    scores = project(entries, found.parts, 2)
    return scores.select(F.col("row").alias("p_partkey"), F.round(F.col("scores")[0], 3).alias("score"))


@query(
    "t4_feature_parts",
    f"SELECT table_name, column_name, CAST({T.TEXT_DIMENSIONS + len(T.MOMENTS) + len(T.SHAPE) + len(T.FLAGS) + 1} AS INTEGER) AS stage_1, CAST({len(T.SHAPE) + len(T.FLAGS) + len(T.DIGITS)} AS INTEGER) AS stage_2_numbers FROM {LISTED_SQL}",
)
def t4_feature_parts(spark, sf_dir):
    profiles = labelled_profiles(spark, sf_dir)
    first = _named(T.TypeFeatures(1).fit(profiles).transform(profiles)).select(
        "table_name", "column_name", F.size(vector_to_array("features")).alias("stage_1")
    )
    second = _named(T.TypeFeatures(2).fit(profiles).transform(profiles)).select(
        "table_name", "column_name",
        (F.size(vector_to_array("features")) - F.size(vector_to_array("text_vec"))).alias("stage_2_numbers"),
    )
    return first.join(second, ["table_name", "column_name"])


@query("t8_predictions_in_range", f"SELECT table_name, column_name, true AS type_known, true AS sums_to_one FROM {LISTED_SQL}")
def t8_predictions_in_range(spark, sf_dir):
    profiles = labelled_profiles(spark, sf_dir)
    found = _named(T.TypeClassifier(trees=10).fit(profiles).transform(profiles.drop("type")))
    one = [F.abs(_filled(f"probability_{i}") - 1) < 1e-9 for i in (1, 2)]
    return found.select(
        "table_name", "column_name", F.col("type").isin(*I.TYPE_NAMES).alias("type_known"), (one[0] & one[1]).alias("sums_to_one")
    )


@query("t13_reload_agrees", f"SELECT table_name, column_name, true AS same FROM {LISTED_SQL}")
def t13_reload_agrees(spark, sf_dir):
    profiles = labelled_profiles(spark, sf_dir)
    path = fresh_path(spark, "types")
    fitted = T.TypeClassifier(trees=10).fit(profiles)
    fitted.save(path)
    again = T.TypeClassifierModel.load(spark, path)
    keys = ["table_name", "column_name"]
    before, after = (
        _named(m.transform(profiles)).select(*keys, F.struct("type", *[vector_to_array(f"probability_{i}").alias(f"p{i}") for i in (1, 2)]).alias(n))
        for m, n in ((fitted, "before"), (again, "after"))
    )
    close = lambda i: F.forall(
        F.zip_with(F.col(f"before.p{i}"), F.col(f"after.p{i}"), lambda a, b: F.abs(a - b)), lambda d: d < 1e-9
    )
    same = (F.col("before.type") == F.col("after.type")) & close(1) & close(2)
    return before.join(after, keys).select(*keys, same.alias("same"))


@query(
    "m6_predictions_in_range",
    """SELECT doc_id, CASE WHEN b < 60 THEN 'train' WHEN b < 75 THEN 'validation' ELSE 'test' END AS split, quality, true AS class_known
FROM (SELECT d.doc_id, quality, ('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 4))::INT % 100 AS b FROM documents d JOIN labels USING (doc_id))""",
)
def m6_predictions_in_range(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = M.hash_split(docs.select("doc_id", "text", "lang", "source", "n_chars", "quality"), "doc_id")
    types = {"text": 3, "lang": 1, "source": 1, "n_chars": 0}
    (pipeline,) = Mo.build_pipeline(types, ["quality"], "classification", learner="rf")
    found = pipeline.fit(rows.filter(F.col("split") == "train")).transform(rows)
    return found.select("doc_id", "split", "quality", F.col("quality_predicted").isin(0.0, 1.0).alias("class_known"))


@query(
    "m5_enriched_numbers",
    with_views("dv_part") + f"""SELECT p_partkey, {digits('unit_text')} * CASE trim(regexp_replace(unit_text, '[0-9.]+', '', 'g')) {UNIT_CASE} ELSE 1.0 END AS unit_text,
  {digits('embed_text')} AS embed_text FROM dv_part""",
)
def m5_enriched_numbers(spark, sf_dir):
    df = view(spark, sf_dir, "dv_part").select("p_partkey", "unit_text", "embed_text")
    return Mo.enrich(df, {"unit_text": I.UNIT, "embed_text": I.EMBEDDED}, key="p_partkey")[0]


# --- boosted trees of many classes: line items by their worth -------------------

BOOSTED = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "ship_month"]
WORTH = "l_quantity * (1 - l_discount) * (1 + l_tax)"
BAND_SQL = f"CASE WHEN {WORTH} < 12 THEN 0 WHEN {WORTH} < 30 THEN 1 ELSE 2 END"
FIRST_DEPTH = 2


def _first_tree_sql() -> str:
    """CTEs of the first round: ``b<level>`` has the split of each node, ``r<level>`` the rows by node."""
    columns = ", ".join(f"CAST({c} AS DOUBLE) AS f{i}" for i, c in enumerate([*BOOSTED[:-1], "month(l_shipdate)"]))
    out = [
        f"x AS (SELECT {BAND_SQL} AS y, {columns} FROM lineitem)",
        "p AS (SELECT y AS c, count(*) / (SELECT count(*) FROM x)::DOUBLE AS p FROM x GROUP BY y)",
        "r0 AS (SELECT x.*, c, p - (y = c)::INT AS g, p * (1 - p) AS h, 1 AS node FROM x, p)",
    ]
    for level in range(FIRST_DEPTH):
        values = " UNION ALL ".join(
            f"SELECT c, node, {i} AS f, f{i} AS v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM r{level} GROUP BY c, node, f{i}"
            for i in range(len(BOOSTED))
        )
        of = "CASE f " + " ".join(f"WHEN {i} THEN f{i}" for i in range(len(BOOSTED))) + " END"
        out += [
            f"u{level} AS ({values})",
            f"""s{level} AS (SELECT c, node, f, v, sum(g) OVER a AS gl, sum(h) OVER a AS hl, sum(n) OVER a AS nl, sum(g) OVER t AS ga, sum(h) OVER t AS ha, sum(n) OVER t AS na
FROM u{level} WINDOW a AS (PARTITION BY c, node, f ORDER BY v), t AS (PARTITION BY c, node, f))""",
            f"""b{level} AS (SELECT c, node, f, v, gain FROM (SELECT *, gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1) AS gain FROM s{level} WHERE nl >= 20 AND na - nl >= 20)
WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY c, node ORDER BY gain DESC, f, v) = 1)""",
            f"r{level + 1} AS (SELECT r.* EXCLUDE (node), CASE WHEN f IS NULL THEN r.node ELSE 2 * r.node + ({of} > v)::INT END AS node FROM r{level} r LEFT JOIN b{level} b ON r.c = b.c AND r.node = b.node)",
        ]
    return "WITH " + ",\n".join(out)


def _worth_bands(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    rows = items.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", F.month("l_shipdate").alias("ship_month"), F.expr(BAND_SQL).alias("band")
    )
    return VectorAssembler(inputCols=BOOSTED, outputCol="features", handleInvalid="keep").transform(rows)


def _first_trees(spark, sf_dir):
    rows = _worth_bands(spark, sf_dir)
    model = BoostedTrees(labelCol="band", rounds=1, depth=FIRST_DEPTH, leaves=2**FIRST_DEPTH).fit(rows)
    names = "round int, class int, node int, feature int, cut double, missing_left boolean, value double, n long, gain double"
    return spark.createDataFrame(model.nodes(), names)


@query(
    "m6_boosted_splits",
    _first_tree_sql() + " " + " UNION ALL ".join(
        f"SELECT c AS class, node, CASE f {' '.join(f'WHEN {i} THEN {quoted([n])}' for i, n in enumerate(BOOSTED))} END AS feature, v AS cut, round(gain, 3) AS gain FROM b{level}"
        for level in range(FIRST_DEPTH)
    ),
)
def m6_boosted_splits(spark, sf_dir):
    names = F.array(*map(F.lit, BOOSTED))
    made = _first_trees(spark, sf_dir).where("feature >= 0")
    return made.select("class", "node", F.get(names, F.col("feature")).alias("feature"), "cut", F.round("gain", 3).alias("gain"))


@query(
    "m6_boosted_leaves",
    _first_tree_sql() + f" SELECT c AS class, node, count(*) AS n, round(-{Mo.RATE} * sum(g) / (sum(h) + 1), 4) AS value FROM r{FIRST_DEPTH} GROUP BY c, node",
)
def m6_boosted_leaves(spark, sf_dir):
    return _first_trees(spark, sf_dir).where("feature < 0").select("class", "node", "n", F.round("value", 4).alias("value"))


@query("m6_boosted_bands")
def m6_boosted_bands(spark, sf_dir):
    """All rounds on the training part; every row with its part, its band and the predicted one."""
    rows = M.hash_split(_worth_bands(spark, sf_dir), ["l_orderkey", "l_linenumber"])
    model = BoostedTrees(labelCol="band", rounds=Mo.ROUNDS, depth=Mo.DEPTH, leaves=Mo.LEAVES, rate=Mo.RATE).fit(rows.where("split = 'train'"))
    return model.transform(rows).select("l_orderkey", "l_linenumber", "split", "band", F.col("prediction").cast("int").alias("predicted"))
