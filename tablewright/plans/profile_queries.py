"""Queries over column profiles and the type decisions built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.cells import display_missing_pct, is_number
from tablewright.functions.samples import STOP_WORDS
from tablewright.operators import profile as P
from tablewright.operators import states as St
from tablewright.plans.registry import query, table
from tablewright.plans.views import VIEWS, view, with_views
from tablewright.session import fresh_path

# name -> (key, columns profiled)
PROFILED = {
    "orders": ("o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
    "customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "dv_part": ("p_partkey", ["p_partkey", "p_size", "p_type", "const_text", "unit_text", "one_unit_text", "sign_text", "range_text", "no_range_text", "embed_text", "list_text", "wide_list_text", "code_text", "mixed_text", "sentinel_text", "type_nullable", "size_nullable"]),
}
SAMPLED = {
    **{k: v for k, v in PROFILED.items() if k != "orders"},
    "documents": ("doc_id", ["doc_id", "text", "lang", "source", "n_chars"]),
    "pages": ("page_id", ["page_id", "url", "html"]),
    "dv_dates": ("o_orderkey", ["o_orderkey", "o_orderdate", "iso_text", "loose_text", "era_text", "era_mixed"]),
    "events": ("event_id", ["event_id", "ts", "user_id", "event_type", "value", "props"]),
}
KIND = {
    "o_orderkey": "integer", "o_custkey": "integer", "o_totalprice": "floating", "o_orderdate": "datetime",
    "c_custkey": "integer", "c_nationkey": "integer", "c_acctbal": "floating", "value": "floating",
    "p_partkey": "integer", "p_size": "integer", "size_nullable": "integer", "doc_id": "integer", "n_chars": "integer",
    "page_id": "integer", "event_id": "integer", "user_id": "integer", "ts": "datetime",
}


def load(spark, sf_dir, name) -> DataFrame:
    return view(spark, sf_dir, name) if name in VIEWS else table(spark, sf_dir, name)


def per_table(spark, sf_dir, tables, build) -> DataFrame:
    """Union of one small frame per table, with the table's name."""
    frames = [
        build(load(spark, sf_dir, name), key, columns).select(F.lit(name).alias("table_name"), "*")
        for name, (key, columns) in tables.items()
    ]
    return reduce(DataFrame.unionByName, frames)


def with_used(tables, *more) -> str:
    names = [n for n in tables if n in VIEWS]
    head = with_views(*names) + "," if names else "WITH"
    return head + ",".join(more)


def arms(tables, template) -> str:
    """One UNION ALL arm per column; ``{t} {c} {k} {num} {dt}`` are filled in."""
    return "\nUNION ALL\n".join(
        template.format(
            t=t, c=c, k=key,
            dt=KIND.get(c, "string"),
            num="true" if KIND.get(c) in ("integer", "floating") else "false",
            x=f"CAST({c} AS DOUBLE)" if KIND.get(c) in ("integer", "floating") else "CAST(NULL AS DOUBLE)",
        )
        for t, (key, columns) in tables.items()
        for c in columns
    )


def samples_cte(tables) -> str:
    body = arms(
        tables,
        """SELECT '{t}' AS table_name, '{c}' AS cname, '{dt}' AS dtype, count(*) > 0 AS has_values,
  coalesce(list(v ORDER BY f, v), ['NaN']) AS s FROM (
  SELECT CAST({c} AS VARCHAR) AS v, min({k}) AS f FROM {t} WHERE {c} IS NOT NULL
  GROUP BY 1 ORDER BY f, v LIMIT 5)""",
    )
    return f"""first_values AS ({body}),
samples AS (SELECT table_name, cname, dtype, has_values,
  list_transform(range(0, 5), lambda i: s[(i % len(s)) + 1]) AS s FROM first_values)"""


def shape_cte() -> str:
    words = ", ".join(f"'{w}'" for w in STOP_WORDS)
    measures = {
        "word_count": "len(string_split(v, ' '))",
        "stopword_total": f"len(list_filter(regexp_extract_all(v, '[A-Za-z]+'), lambda w: w IN ({words})))",
        "char_count": "length(v)",
        "whitespace_count": "len(regexp_extract_all(v, ' '))",
        "delim_count": "len(regexp_extract_all(v, '[,;:|]'))",
    }
    columns = ",\n".join(
        f"round(list_avg(list_transform(s, lambda v: CAST({m} AS DOUBLE))), 6) AS mean_{n}, "
        f"round(list_stddev_pop(list_transform(s, lambda v: CAST({m} AS DOUBLE))), 6) AS std_dev_{n}"
        for n, m in measures.items()
    )
    return f"""shape AS (SELECT *, {columns},
  len(list_filter(s, lambda v: regexp_matches(v, '^[^,;:|]+[,;:|][^,;:|]+'))) > 2 AS has_delimiters,
  len(list_filter(s, lambda v: regexp_matches(v, '^(http|ftp|https)://[\\w-]+(\\.[\\w-]+)+'))) > 2 AS has_url,
  len(list_filter(s, lambda v: regexp_matches(v, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,6}}\\b'))) > 2 AS has_email,
  dtype = 'datetime' OR (dtype = 'string' AND has_values AND
    len(list_filter(s, lambda v: (regexp_matches(v, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') AND TRY_CAST(v AS TIMESTAMP) IS NOT NULL)
      OR regexp_matches(v, '^平成\\d+年\\d+月\\d+日$')
      OR regexp_matches(v, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$|^\\d{{4}}/\\d{{1,2}}/\\d{{1,2}} \\d\\d:\\d\\d$|^(19|20)\\d{{6}}$')
      OR regexp_matches(v, '^(平成|㍻|H)[0-9０-９]|^\\d{{4}}年|^4\\d{{6}}$'))) > 2) AS has_date
FROM samples),
flagged AS (SELECT *, has_delimiters AND mean_char_count < 100 AS is_list, mean_word_count > 10 AS is_long_sentence FROM shape)"""


SHAPE = ["word_count", "stopword_total", "char_count", "whitespace_count", "delim_count"]
FLAGS = ["has_delimiters", "has_url", "has_email", "has_date", "is_list", "is_long_sentence"]


def named():
    return F.col("column").alias("column_name")


def rounded(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


@query(
    "p1_counts",
    with_used(PROFILED, " x AS (SELECT 1)") + arms(
        PROFILED,
        """SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS total_vals,
  count(*) - count({c}) AS num_nans, count(DISTINCT {c}) AS num_of_dist_val FROM {t}""",
    ),
)
def p1_counts(spark, sf_dir):
    return per_table(
        spark, sf_dir, PROFILED,
        lambda df, key, cols: P.column_stats(df, cols).select(named(), "total_vals", "num_nans", "num_of_dist_val"),
    )


MOMENTS = {**PROFILED, "lineitem": (None, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])}
KIND.update({"l_quantity": "floating", "l_extendedprice": "floating", "l_discount": "floating", "l_tax": "floating"})


@query(
    "p2_moments",
    with_used(MOMENTS, " x AS (SELECT 1)") + arms(
        MOMENTS,
        """SELECT '{t}' AS table_name, '{c}' AS column_name, round(coalesce(avg({x}), 0), 4) AS mean,
  round(coalesce(stddev_pop({x}), 0), 4) AS std_dev, coalesce(min({x}), 0) AS min_val, coalesce(max({x}), 0) AS max_val FROM {t}""",
    ),
)
def p2_moments(spark, sf_dir):
    return per_table(
        spark, sf_dir, MOMENTS,
        lambda df, key, cols: P._moments(df, [df.schema[c] for c in cols], False).select(
            named(), *rounded("mean", "std_dev", digits=4), "min_val", "max_val"
        ),
    )


@query(
    "p3_ratios",
    with_used(PROFILED, " x AS (SELECT 1)") + arms(
        PROFILED,
        """SELECT '{t}' AS table_name, '{c}' AS column_name, round(count(DISTINCT {c}) * 100.0::DOUBLE / count(*), 6) AS pct_dist_val,
  round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS pct_nans FROM {t}""",
    ),
)
def p3_ratios(spark, sf_dir):
    return per_table(
        spark, sf_dir, PROFILED,
        lambda df, key, cols: P.column_stats(df, cols).select(named(), *rounded("pct_dist_val", "pct_nans")),
    )


def sample_columns():
    return [F.col("samples")[i].alias(f"sample_{i + 1}") for i in range(5)]


SAMPLE_SQL = ", ".join(f"s[{i}] AS sample_{i}" for i in range(1, 6))


@query("p4_samples", with_used(SAMPLED, samples_cte(SAMPLED)) + f"SELECT table_name, cname AS column_name, {SAMPLE_SQL} FROM samples")
def p4_samples(spark, sf_dir):
    return per_table(
        spark, sf_dir, SAMPLED,
        lambda df, key, cols: P.column_samples(df, key, columns=cols).select(named(), *sample_columns()),
    )


def _shape_names():
    return [f"{p}_{n}" for n in SHAPE for p in ("mean", "std_dev")]


@query(
    "p5_sample_shape",
    with_used(SAMPLED, samples_cte(SAMPLED), shape_cte())
    + f"SELECT table_name, cname AS column_name, {', '.join(_shape_names())} FROM shape",
)
def p5_sample_shape(spark, sf_dir):
    return per_table(
        spark, sf_dir, SAMPLED,
        lambda df, key, cols: P.sample_shape(P.column_samples(df, key, columns=cols)).select(
            named(), *rounded(*_shape_names())
        ),
    )


@query(
    "p6_pattern_flags",
    with_used(SAMPLED, samples_cte(SAMPLED), shape_cte())
    + f"SELECT table_name, cname AS column_name, {', '.join(FLAGS[:4])} FROM flagged",
)
def p6_pattern_flags(spark, sf_dir):
    return per_table(
        spark, sf_dir, SAMPLED,
        lambda df, key, cols: P.sample_shape(P.column_samples(df, key, columns=cols)).select(named(), *FLAGS[:4]),
    )


@query(
    "p7_list_flags",
    with_used(SAMPLED, samples_cte(SAMPLED), shape_cte())
    + f"SELECT table_name, cname AS column_name, {', '.join(FLAGS[4:])} FROM flagged",
)
def p7_list_flags(spark, sf_dir):
    return per_table(
        spark, sf_dir, SAMPLED,
        lambda df, key, cols: P.sample_shape(P.column_samples(df, key, columns=cols)).select(named(), *FLAGS[4:]),
    )


@query(
    "p8_profile",
    with_used(PROFILED, samples_cte(PROFILED), shape_cte(), "stats AS (" + arms(
        PROFILED,
        """SELECT '{t}' AS table_name, '{c}' AS cname, count(*) AS total_vals, count(*) - count({c}) AS num_nans,
  count(DISTINCT {c}) AS num_of_dist_val, round(coalesce(avg({x}), 0), 4) AS mean, round(coalesce(stddev_pop({x}), 0), 4) AS std_dev,
  coalesce(min({x}), 0) AS min_val, coalesce(max({x}), 0) AS max_val,
  round(count(DISTINCT {c}) * 100.0::DOUBLE / count(*), 6) AS pct_dist_val,
  round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS pct_nans FROM {t}""",
    ) + ")")
    + f"""SELECT table_name, cname AS column_name, total_vals, num_nans, num_of_dist_val, mean, std_dev, min_val, max_val,
  pct_dist_val, pct_nans, {SAMPLE_SQL}, {', '.join(FLAGS)}, {', '.join(_shape_names())}
  FROM stats JOIN flagged USING (table_name, cname)""",
)
def p8_profile(spark, sf_dir):
    return per_table(
        spark, sf_dir, PROFILED,
        lambda df, key, cols: P.profile(df, key, cols).select(
            named(), "total_vals", "num_nans", "num_of_dist_val", *rounded("mean", "std_dev", digits=4),
            "min_val", "max_val", *rounded("pct_dist_val", "pct_nans"), *sample_columns(), *FLAGS,
            *rounded(*_shape_names()),
        ),
    )


NUMBER_SQL = r"(regexp_matches({v}, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$') OR regexp_matches(lower({v}), '^\s*[+-]?(nan|inf|infinity)\s*$'))"


def firsts_cte(tables) -> str:
    return "firsts AS (" + arms(
        tables,
        "SELECT '{t}' AS table_name, '{c}' AS column_name, '{dt}' AS dtype, arg_min(CAST({c} AS VARCHAR), {k}) FILTER (WHERE {c} IS NOT NULL) AS v FROM {t}",
    ) + ")"


@query(
    "p9_castable",
    with_used(SAMPLED, firsts_cte(SAMPLED))
    + r"""SELECT table_name, column_name, CASE WHEN dtype = 'string' AND (
  regexp_matches(v, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$') OR regexp_matches(v, '^\s*(''[^'']*''|"[^"]*")\s*$')
  OR trim(v) IN ('True', 'False', 'None') OR (regexp_matches(v, '^\s*[\[{]') AND json_valid(v))) THEN 1 ELSE 0 END AS castable FROM firsts""",
)
def p9_castable(spark, sf_dir):
    return per_table(
        spark, sf_dir, SAMPLED,
        lambda df, key, cols: P.first_value_castable(df, key, cols).withColumnRenamed("column", "column_name"),
    )


@query(
    "p10_number_extractable",
    with_used(SAMPLED, firsts_cte(SAMPLED))
    + r"""SELECT table_name, column_name, CASE WHEN dtype = 'string'
  AND regexp_matches(trim(regexp_replace(v, '[^0-9. ]', ' ', 'g')), '^(\d+\.?\d*|\.\d+)$') THEN 1 ELSE 0 END AS has_number FROM firsts""",
)
def p10_number_extractable(spark, sf_dir):
    return per_table(
        spark, sf_dir, SAMPLED,
        lambda df, key, cols: P.first_value_has_number(df, key, cols).withColumnRenamed("column", "column_name"),
    )


@query(
    "p11_mean_tokens",
    with_used(SAMPLED, samples_cte(SAMPLED))
    + r"""SELECT table_name, cname AS column_name,
  round(list_avg(list_transform(s, lambda v: CAST(len(list_filter(regexp_split_to_array(v, '\s+'), lambda w: w <> '')) AS DOUBLE))), 6) AS mean_tokens FROM samples""",
)
def p11_mean_tokens(spark, sf_dir):
    return per_table(
        spark, sf_dir, SAMPLED,
        lambda df, key, cols: P.mean_sample_tokens(P.column_samples(df, key, columns=cols)).select(
            named(), *rounded("mean_tokens")
        ),
    )


@query(
    "p12_category_size",
    with_used(PROFILED, " x AS (SELECT 1)") + arms(
        PROFILED,
        """SELECT '{t}' AS table_name, '{c}' AS column_name, CASE WHEN count(*) <= 2 THEN 'binary'
  WHEN count(*) <= 20 AND count(*) / sum(n) < 0.3 THEN 'small'
  WHEN sum(n) FILTER (WHERE r <= 20) / sum(n) > 0.8 THEN 'large' ELSE 'none' END AS category_size
  FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS r FROM (SELECT count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}))""",
    ),
)
def p12_category_size(spark, sf_dir):
    return per_table(
        spark, sf_dir, PROFILED,
        lambda df, key, cols: P.category_size(df, cols).select(named(), "category_size"),
    )


# name -> (parts that arrive one by one, columns profiled)
ARRIVING = {
    "orders": ("year(o_orderdate)", PROFILED["orders"][1]),
    "customer": ("c_nationkey", PROFILED["customer"][1]),
    "lineitem": ("l_linestatus", ["l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag"]),
    "events": ("to_date(ts)", ["event_id", "user_id", "event_type", "value", "props"]),
}
KIND.update({"l_orderkey": "integer"})


def stored_states(spark, sf_dir, name) -> DataFrame:
    """The states of a table's parts, written one row per part and column and read back."""
    part, columns = ARRIVING[name]
    path = fresh_path(spark, f"states-{name}")
    St.column_states(load(spark, sf_dir, name), columns, [F.expr(part).alias("part")]).write.parquet(path)
    return spark.read.parquet(path)


def per_arriving(spark, sf_dir, build) -> DataFrame:
    frames = [build(name).select(F.lit(name).alias("table_name"), "*") for name in ARRIVING]
    return reduce(DataFrame.unionByName, frames)


@query(
    "p1_merged_states",
    arms(
        {name: (None, columns) for name, (_, columns) in ARRIVING.items()},
        """SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS total_vals, count(*) - count({c}) AS num_nans,
  count(DISTINCT {c}) AS num_of_dist_val, true AS distinct_in_bound, round(coalesce(avg({x}), 0), 4) AS mean,
  round(coalesce(stddev_pop({x}), 0), 4) AS std_dev, coalesce(min({x}), 0) AS min_val, coalesce(max({x}), 0) AS max_val FROM {t}""",
    ),
)
def p1_merged_states(spark, sf_dir):
    """Merged states of all parts beside exact distinct counts of the whole table."""

    def build(name):
        df, columns = load(spark, sf_dir, name), ARRIVING[name][1]
        stats = St.state_stats(St.merged_states(stored_states(spark, sf_dir, name)))
        exact = P.distinct_counts(P.value_counts(df, None, columns)).select("pos", F.col("num_of_dist_val").alias("exact"))
        exact = stats.join(exact, "pos", "left").withColumn("exact", F.coalesce("exact", F.lit(0).cast("bigint")))
        off = F.abs(F.col("num_of_dist_val") - F.col("exact"))
        return exact.select(
            named(), "total_vals", "num_nans", F.col("exact").alias("num_of_dist_val"),
            (off <= St.distinct_bound() * F.col("exact")).alias("distinct_in_bound"),
            *rounded("mean", "std_dev", digits=4), "min_val", "max_val",
        )

    return per_arriving(spark, sf_dir, build)


@query(
    "p12_merged_category_size",
    arms(
        {name: (None, columns) for name, (_, columns) in ARRIVING.items()},
        """SELECT '{t}' AS table_name, '{c}' AS column_name, CASE WHEN count(*) <= 2 THEN 'binary'
  WHEN count(*) <= 20 AND count(*) / sum(n) < 0.3 THEN 'small'
  WHEN sum(n) FILTER (WHERE r <= 20) / sum(n) > 0.8 THEN 'large' ELSE 'none' END AS category_size
  FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS r FROM (SELECT count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}))""",
    ),
)
def p12_merged_category_size(spark, sf_dir):
    return per_arriving(
        spark, sf_dir,
        lambda name: St.state_category_size(St.merged_states(stored_states(spark, sf_dir, name))).select(named(), "category_size"),
    )


@query(
    "p12_merged_heavy_hitters",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS part, o_orderpriority AS value, count(*) AS n
  FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY ALL""",
)
def p12_merged_heavy_hitters(spark, sf_dir):
    """Heavy hitters of each year out of the states of its months: exact while a column has few values."""
    parts = [F.year("o_orderdate").alias("part"), F.month("o_orderdate").alias("month")]
    months = St.column_states(table(spark, sf_dir, "orders"), ["o_orderpriority"], parts)
    return St.state_heavy_hitters(St.merged_states(months, ["part"])).select("part", "value", "n")


def shares_cte(tables) -> str:
    number = NUMBER_SQL.split(" OR ")[0].strip("(").replace("{v}", "CAST({c} AS VARCHAR)")
    number = number.replace("{c}", "@c@").replace("{", "{{").replace("}", "}}").replace("@c@", "{c}")
    return "shares AS (" + arms(
        tables,
        "SELECT '{t}' AS table_name, '{c}' AS column_name, '{dt}' AS dtype, coalesce(count(*) FILTER (WHERE "
        + number + ") / count({c})::DOUBLE, 0) AS share FROM {t}",
    ) + ")"


MIXED = {"dv_part": ("p_partkey", ["p_size", "mixed_text", "unit_text", "size_nullable", "type_nullable"]),
         "customer": PROFILED["customer"]}


@query(
    "p13_mixed",
    with_used(MIXED, shares_cte(MIXED), "words AS (" + arms(
        MIXED,
        """SELECT '{t}' AS table_name, '{c}' AS column_name, list(v ORDER BY k) AS w FROM (
  SELECT CAST({c} AS VARCHAR) AS v, {k} AS k FROM {t} WHERE '{dt}' = 'string' AND {c} IS NOT NULL AND NOT """
        + NUMBER_SQL.replace("{v}", "CAST(@c@ AS VARCHAR)").replace("{", "{{").replace("}", "}}").replace("@c@", "{c}")
        + " ORDER BY k LIMIT 5)",
    ) + ")")
    + """SELECT table_name, column_name, round(share, 6) AS number_share, share > 0 AND share < 1 AS is_mixed,
  CASE WHEN share > 0 AND share < 1 THEN coalesce(array_to_string(w, '|'), '') ELSE '' END AS override
  FROM shares LEFT JOIN words USING (table_name, column_name)""",
)
def p13_mixed(spark, sf_dir):
    return per_table(
        spark, sf_dir, MIXED,
        lambda df, key, cols: P.mixed_columns(df, key, cols).select(
            named(), *rounded("number_share"), "is_mixed", F.array_join("override", "|").alias("override")
        ),
    )


@query(
    "p14_all_numeric",
    with_used(SAMPLED, samples_cte(SAMPLED))
    + f"SELECT table_name, cname AS column_name, len(list_filter(s, lambda v: {NUMBER_SQL.replace('{v}', 'v')})) = 5 AS all_numeric FROM samples",
)
def p14_all_numeric(spark, sf_dir):
    return per_table(
        spark, sf_dir, SAMPLED,
        lambda df, key, cols: P.numeric_samples(P.column_samples(df, key, columns=cols)).withColumnRenamed("column", "column_name"),
    )


@query(
    "p15_digits",
    with_used(SAMPLED, samples_cte(SAMPLED))
    + r"""SELECT table_name, cname AS column_name,
  round(list_avg(list_transform(s, lambda v: CAST(len(regexp_extract_all(v, '[0-9]')) AS DOUBLE))), 6) AS num_number_characters,
  round(list_avg(list_transform(s, lambda v: CAST(len(regexp_extract_all(v, '-?[0-9]+\.?[0-9]*')) AS DOUBLE))), 6) AS num_separated_tokens,
  CAST(len(list_filter(s, lambda v: contains(v, ','))) AS INTEGER) AS comma_include FROM samples""",
)
def p15_digits(spark, sf_dir):
    return per_table(
        spark, sf_dir, SAMPLED,
        lambda df, key, cols: P.sample_digits(P.column_samples(df, key, columns=cols)).select(
            named(), *rounded("num_number_characters", "num_separated_tokens"), "comma_include"
        ),
    )


P16_TEXTS = ["unit_text", "mixed_text", "sentinel_text", "code_text"]


@query(
    "p16_is_number",
    with_views("dv_part") + "SELECT p_partkey, " + ", ".join(
        f"{NUMBER_SQL.replace('{v}', c)} AS {c}_is_number" for c in P16_TEXTS
    ) + " FROM dv_part",
)
def p16_is_number(spark, sf_dir):
    parts = view(spark, sf_dir, "dv_part")
    return parts.select("p_partkey", *[is_number(F.col(c)).alias(f"{c}_is_number") for c in P16_TEXTS])


@query(
    "p17_value_type",
    with_used(SAMPLED, shares_cte(SAMPLED))
    + "SELECT table_name, column_name, CASE WHEN dtype = 'string' AND share > 0 AND share < 1 THEN 'mixed' ELSE dtype END AS value_type FROM shares",
)
def p17_value_type(spark, sf_dir):
    return per_table(
        spark, sf_dir, SAMPLED,
        lambda df, key, cols: P.value_types(df, key, cols).withColumnRenamed("column", "column_name"),
    )


@query(
    "p18_missing_pct",
    with_used(PROFILED, " x AS (SELECT 1)") + "SELECT table_name, column_name, CAST(CASE WHEN p > 0 AND p < 1 THEN 1 ELSE floor(p) END AS BIGINT) AS missing_pct FROM (" + arms(
        PROFILED,
        "SELECT '{t}' AS table_name, '{c}' AS column_name, (count(*) - count({c})) * 100.0::DOUBLE / (count(*) + 1e-9) AS p FROM {t}",
    ) + ")",
)
def p18_missing_pct(spark, sf_dir):
    return per_table(
        spark, sf_dir, PROFILED,
        lambda df, key, cols: P._moments(df, [df.schema[c] for c in cols], False).select(
            named(), display_missing_pct(F.col("num_nans"), F.col("total_vals")).alias("missing_pct")
        ),
    )


@query(
    "p19_numeric_fields",
    with_used(PROFILED, " x AS (SELECT 1)") + arms(
        PROFILED,
        "SELECT '{t}' AS table_name, '{c}' AS column_name, {num} AS is_numeric, count({c}) AS non_null FROM {t}",
    ),
)
def p19_numeric_fields(spark, sf_dir):
    return per_table(
        spark, sf_dir, PROFILED,
        lambda df, key, cols: P.numeric_fields(df, cols).withColumnRenamed("column", "column_name"),
    )
