"""Views derived from the given tables, in one dialect both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.plans.registry import table

_KANJI_DAY = """
  CASE WHEN day(o_orderdate) >= 20 THEN translate(CAST(CAST(floor(day(o_orderdate) / 10) AS INT) AS STRING), '123', '一二三') ELSE '' END
  || CASE WHEN day(o_orderdate) >= 10 THEN '十' ELSE '' END
  || CASE WHEN day(o_orderdate) % 10 = 0 THEN '' ELSE translate(CAST(day(o_orderdate) % 10 AS STRING), '123456789', '一二三四五六七八九') END"""

_WEIGHTS = ("w0", "w1", "w2", "CAST(1 AS DOUBLE) - w0 - w1 - w2")
_LINES = """
  SELECT l_orderkey AS table_id, l_linenumber AS column_id,
    CAST(min(l_partkey) % 40 AS DOUBLE) / 128 AS w0, CAST(min(l_suppkey) % 40 AS DOUBLE) / 128 AS w1,
    CAST(max(l_partkey) % 40 AS DOUBLE) / 128 AS w2
  FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""

VIEWS = {
    # One text column per value format.
    "dv_part": (
        ["part"],
        """
SELECT p_partkey, p_size, p_type, 'metric' AS const_text,
  CAST(p_size AS STRING) || ' ' || CASE p_size % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'g' WHEN 2 THEN 'mg' ELSE 'lb' END AS unit_text,
  CAST(p_size AS STRING) || ' km' AS one_unit_text,
  CASE p_size % 6 WHEN 0 THEN '< ' WHEN 1 THEN '> ' WHEN 2 THEN '>=' WHEN 3 THEN 'over ' WHEN 4 THEN 'Smaller than ' ELSE 'less than ' END || CAST(p_size AS STRING) AS sign_text,
  CASE WHEN p_size % 7 = 0 THEN CAST(p_size AS STRING) ELSE CAST(p_size AS STRING) || ' - ' || CAST(p_size + 5 AS STRING) END AS range_text,
  CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS STRING) || ' pcs' ELSE CAST(p_size AS STRING) END AS no_range_text,
  'USD' || CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) || '/ea' AS embed_text,
  '[''' || replace(p_name, ' ', ''', ''') || ''']' AS list_text,
  '[' || CAST(p_partkey AS STRING) || '; ' || CAST(p_partkey * 7 + p_size AS STRING) || '; ' || p_type || ']' AS wide_list_text,
  substr(p_type, 1, 3) || '-' || CAST(p_size AS STRING) || '-' || CAST(p_partkey AS STRING) AS code_text,
  CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE CAST(p_size AS STRING) END AS mixed_text,
  CASE p_size % 10 WHEN 0 THEN '-99999' WHEN 1 THEN 'x' WHEN 2 THEN '-' ELSE CAST(p_size AS STRING) || ',000' END AS sentinel_text,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS type_nullable,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size END AS size_nullable
FROM {part}
""",
    ),
    # ISO text, several era spellings, and text that cannot be parsed.
    "dv_dates": (
        ["orders"],
        """
SELECT o_orderkey, o_orderdate,
  CASE WHEN o_orderkey % 17 = 0 THEN 'None' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS iso_text,
  CASE o_orderkey % 4
    WHEN 0 THEN CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING)
    WHEN 1 THEN CAST(year(o_orderdate) AS STRING) || '/' || CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING) || ' 07:30'
    WHEN 2 THEN replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '')
    ELSE 'soon' END AS loose_text,
  '平成' || CAST(year(o_orderdate) - 1988 AS STRING) || '年' || CAST(month(o_orderdate) AS STRING) || '月' || CAST(day(o_orderdate) AS STRING) || '日' AS era_text,
  CASE o_orderkey % 6
    WHEN 0 THEN '平成' || translate(CAST(year(o_orderdate) - 1988 AS STRING), '0123456789', '０１２３４５６７８９') || '年' || CAST(month(o_orderdate) AS STRING) || '月' || CAST(day(o_orderdate) AS STRING) || '日'
    WHEN 1 THEN 'H' || CAST(year(o_orderdate) - 1988 AS STRING) || '.' || CAST(month(o_orderdate) AS STRING) || '.' || CAST(day(o_orderdate) AS STRING)
    WHEN 2 THEN '㍻' || CAST(year(o_orderdate) - 1988 AS STRING) || '年' || CAST(month(o_orderdate) AS STRING) || '月'"""
        + " || ("
        + _KANJI_DAY
        + """) || '日'
    WHEN 3 THEN CAST(year(o_orderdate) AS STRING) || '年' || CAST(month(o_orderdate) AS STRING) || '月' || CAST(day(o_orderdate) AS STRING) || '日'
    WHEN 4 THEN '4' || substr(CAST((year(o_orderdate) - 1988) * 10000 + 1000000 + month(o_orderdate) * 100 + day(o_orderdate) AS STRING), 2)
    ELSE '平成' || CAST(year(o_orderdate) - 1988 AS STRING) || '年' || CAST(month(o_orderdate) AS STRING) || '月' || CAST(day(o_orderdate) AS STRING) || '日9時5分' END AS era_mixed
FROM {orders}
""",
    ),
    # Numbers with NaN, infinities and nulls, null keys and categories, and long texts that tie.
    "dv_gaps": (
        ["orders"],
        """
SELECT o_orderkey, o_custkey, o_orderpriority,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderkey END AS some_key,
  CASE o_orderkey % 11 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN NULL WHEN 2 THEN CAST('Infinity' AS DOUBLE)
    ELSE floor(o_totalprice / 100) END AS price,
  CASE o_orderkey % 13 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST(-1 AS DOUBLE) ELSE CAST(o_orderkey % 7 AS DOUBLE) + 8 END AS grade,
  CASE WHEN o_orderkey % 23 = 0 THEN 'only under a null key' WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL
    ELSE repeat('long text before the end ', 4) || substr('hgfedcba', CAST(o_orderkey % 8 AS INT) + 1, 1) END AS long_text
FROM {orders}
""",
    ),
    # Dataset metadata, one row per customer.
    "dv_licenses": (
        ["customer"],
        """
SELECT c_custkey AS dataset_key, c_name AS title, c_mktsegment AS publisher,
  CASE c_nationkey % 8 WHEN 0 THEN 'us-pd' WHEN 1 THEN 'Creative Commons Attribution'
    WHEN 2 THEN 'CC-BY-NC-SA-4.0' WHEN 3 THEN 'Creative Commons Attribution Share-Alike'
    WHEN 4 THEN 'License not specified' WHEN 5 THEN 'Custom-SA-1.0'
    WHEN 6 THEN '' ELSE 'Some Unknown Terms' END AS license
FROM {customer}
""",
    ),
    # Every user turn with the assistant turn that follows it.
    "dv_qa": (
        ["conversations"],
        """
SELECT q.conv_id, q.turn, q.text AS question, a.text AS target,
  CASE WHEN (q.conv_id * 7 + q.turn) % 5 = 0 THEN a.text || '!' ELSE a.text END AS pred
FROM {conversations} q JOIN {conversations} a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user' AND a.role = 'assistant'
""",
    ),
    # Judged (gold, predicted) pairs with ties: an order against its parts.
    "dv_scores": (
        ["lineitem"],
        """
SELECT l_orderkey % 50 AS dataset, l_orderkey AS gt_id, l_partkey AS pred_id,
  CAST((l_orderkey * 31 + l_partkey * 17) % 11 AS DOUBLE) / 10 AS score
FROM {lineitem}
""",
    ),
    # One vote per judge on every order.
    "dv_votes": (
        ["lineitem"],
        """
SELECT l_orderkey AS item_id, l_linenumber AS judge,
  CASE WHEN l_returnflag = 'N' OR l_linestatus = 'F' THEN 'Same' WHEN l_returnflag = 'A' THEN 'Different' ELSE NULL END AS verdict
FROM {lineitem}
""",
    ),
    # Insights with references to questions, in both accepted spellings.
    "dv_refs": (
        ["conversations"],
        """
SELECT conv_id, turn AS idx, text AS insight,
  CASE WHEN turn % 2 = 0 THEN '[''Q_0_' || CAST(turn AS STRING) || ''', ''Q_0_' || CAST(turn + 1 AS STRING) || ''']'
       ELSE 'Q_0_' || CAST(turn AS STRING) || ', Q_0_' || CAST(turn + 1 AS STRING) END AS reference
FROM {conversations} WHERE role = 'assistant'
""",
    ),
    # Class probabilities of the "columns" of many small "tables": orders and their lines.
    "dv_proba": (["lineitem"], "SELECT table_id, column_id, inline(array(" + ", ".join(
        f"struct({i} AS class, {p} AS probability)" for i, p in enumerate(_WEIGHTS)
    ) + ")) FROM (" + _LINES + ") t"),
}


# The one view whose unfolding is spelled differently in SQL.
SQL_TEXT = {
    "dv_proba": "SELECT table_id, column_id, unnest([0, 1, 2, 3]) AS class, unnest([" + ", ".join(_WEIGHTS)
    + "]) AS probability FROM (" + _LINES + ") t",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived view as a DataFrame."""
    sources, text = VIEWS[name]
    return spark.sql(text, **{s: table(spark, sf_dir, s) for s in sources})


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the views for the SQL side."""
    ctes = []
    for name in names:
        sources, text = VIEWS[name]
        text = SQL_TEXT.get(name, text)
        for s in sources:
            text = text.replace("{" + s + "}", s)
        ctes.append(f"{name} AS ({text})")
    return "WITH " + ",\n".join(ctes)
