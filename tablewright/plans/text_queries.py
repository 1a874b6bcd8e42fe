"""Queries over table descriptions, transcripts and text extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import text as W
from tablewright.operators import describe as D
from tablewright.operators import infer as I
from tablewright.operators.pages import main_text
from tablewright.plans.registry import query, table
from tablewright.plans.views import view, with_views

DESCRIBED = {
    "orders": {"o_orderkey": 7, "o_custkey": 0, "o_orderstatus": 1, "o_totalprice": 0, "o_orderdate": 2, "o_orderpriority": 1},
    "customer": {"c_custkey": 7, "c_name": 3, "c_nationkey": 1, "c_acctbal": 0, "c_mktsegment": 1},
    "dv_part": {
        "p_partkey": 7, "p_size": 1, "p_type": 1, "const_text": 3, "unit_text": 8, "one_unit_text": 8, "sign_text": 10, "range_text": 9,
        "no_range_text": 9, "embed_text": 5, "list_text": 6, "wide_list_text": 6, "code_text": 11, "mixed_text": 1, "sentinel_text": 1,
        "type_nullable": 1, "size_nullable": 0,
    },
    "pages": {"page_id": 7, "url": 4, "html": 3},
    "dv_gaps": {"o_orderkey": 7, "o_custkey": 0, "o_orderpriority": 1, "some_key": 0, "price": 0, "grade": 0, "status": 1, "long_text": 3},
}
VALUE_TYPE = {
    "o_orderkey": "integer", "o_custkey": "integer", "o_totalprice": "floating", "o_orderdate": "datetime",
    "c_custkey": "integer", "c_nationkey": "integer", "c_acctbal": "floating", "p_size": "integer", "size_nullable": "integer",
    "p_partkey": "integer", "page_id": "integer", "some_key": "integer", "price": "floating", "grade": "floating",
    "range_text": "mixed", "no_range_text": "mixed", "mixed_text": "mixed", "sentinel_text": "mixed",
}
# NaN and infinities are missing.
FINITE_SQL = ", finite_gaps AS (SELECT * REPLACE (CASE WHEN isfinite(price) THEN price END AS price, CASE WHEN isfinite(grade) THEN grade END AS grade) FROM dv_gaps)"



def _detail(t, c, code):
    if code == 0:
        return f"'Value range is [' || CAST(min({c}) AS VARCHAR) || ', ' || CAST(max({c}) AS VARCHAR) || '].'"
    if code == 2:
        return f"'Start date is ' || CAST(min({c}) AS VARCHAR) || ', and end date is ' || CAST(max({c}) AS VARCHAR) || '.'"
    if code == 4:
        return "''"

    def top(n):
        return (
            f"(SELECT string_agg(v, ', ' ORDER BY n DESC, v) FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {t} "
            f"WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT {n}))"
        )

    if code == 1:
        return f"CASE WHEN count(DISTINCT {c}) > 20 THEN 'Selected 20' ELSE 'All' END || ' categories are [' || {top(20)} || '].'"
    return f"'Selected 10 unique examples are [' || {top(10)} || '].'"


def described_cte(tables) -> str:
    arms = []
    for t, columns in tables.items():
        for i, (c, code) in enumerate(columns.items()):
            code = 1 if c == "const_text" else code
            rows = "finite_gaps" if t == "dv_gaps" else t
            arms.append(
                f"SELECT '{t}' AS table_name, {i} AS pos, '{c}' AS column_name, '{I.TYPE_NAMES[code]}' AS type_name, "
                f"'{VALUE_TYPE.get(c, 'string')}' AS value_type, CAST(CASE WHEN p > 0 AND p < 1 THEN 1 ELSE floor(p) END AS BIGINT) AS missing_pct, detail, total AS rows "
                f"FROM (SELECT (count(*) - count({c})) * 100.0::DOUBLE / (count(*) + 1e-9) AS p, {_detail(rows, c, code)} AS detail, count(*) AS total FROM {rows})"
            )
    return "described AS (" + "\nUNION ALL\n".join(arms) + ")"


LINE_SQL = """column_name || ' (feature type: ' || type_name || ') (value type: ' || value_type || ') (ratio of missing values: '
  || CAST(missing_pct AS VARCHAR) || '%)' || CASE WHEN detail <> '' THEN ': ' || detail ELSE '' END"""
TEXT_SQL = f"""'Number of columns: ' || CAST(count(*) AS VARCHAR) || chr(10) || 'Number of rows: ' || CAST(max(rows) AS VARCHAR) || chr(10)
  || string_agg({LINE_SQL}, chr(10) ORDER BY pos)"""


def _load(spark, sf_dir, name):
    return view(spark, sf_dir, name) if name.startswith("dv_") else table(spark, sf_dir, name)


@query(
    "d1_describe",
    with_views("dv_part", "dv_gaps") + FINITE_SQL + "," + described_cte(DESCRIBED)
    + "SELECT table_name, column_name, type_name, value_type, missing_pct, detail, rows FROM described",
)
def d1_describe(spark, sf_dir):
    out = None
    for name, types in DESCRIBED.items():
        df = _load(spark, sf_dir, name).select(*types)
        one = D.describe_table(df, types).select(
            F.lit(name).alias("table_name"), F.col("column").alias("column_name"),
            "type_name", "value_type", "missing_pct", "detail", "rows",
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "d2_preview",
    """SELECT row_number() OVER (ORDER BY o_orderkey) AS position, concat_ws(' ', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus,
  CAST(o_totalprice AS VARCHAR), CAST(o_orderdate AS VARCHAR), o_orderpriority) AS line FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 10)""",
)
def d2_preview(spark, sf_dir):
    shown = D.preview(table(spark, sf_dir, "orders"), "o_orderkey")
    return shown.withColumn("position", F.col("position").cast("bigint"))


FILES = [("orders", "Orders", "Every order"), ("customer", "Customers", "Every customer"), ("dv_part", "Parts", "Part texts")]


@query(
    "d3_describe_dataset",
    with_views("dv_part") + "," + described_cte({t: DESCRIBED[t] for t, *_ in FILES})
    + f", texts AS (SELECT table_name, {TEXT_SQL} AS text FROM described GROUP BY table_name)"
    + " SELECT f.position, f.nth || ' table' || chr(10) || 'Dataset title: ' || f.title || chr(10) || 'Dataset description: ' || f.about || chr(10) || chr(10) || 'Headers and values:' || chr(10) || text AS text FROM texts JOIN (VALUES "
    + ", ".join(f"({i}, '{n}', '{t}', '{a}', '{b}')" for i, (n, (t, a, b)) in enumerate(zip(("1st", "2nd", "3rd"), FILES)))
    + ") f(position, nth, table_name, title, about) USING (table_name)",
)
def d3_describe_dataset(spark, sf_dir):
    files = ", ".join(
        f"named_struct('file_name', '{t}.csv', 'file_title', '{a}', 'file_description', '{b}')" for t, a, b in FILES
    )
    metadata = spark.range(1).select(F.expr(f"array({files})").alias("distribution"))
    tables = [(_load(spark, sf_dir, t).select(*DESCRIBED[t]), None, DESCRIBED[t]) for t, *_ in FILES]
    return D.describe_dataset(tables, metadata)


@query(
    "d4_flatten_notes",
    """SELECT p_partkey, p_name || ': label is ' || p_type || '. description is ' || p_brand || '. values is ' || p_brand || '/' || p_type || '.'
  || CASE WHEN p_size % 2 = 0 THEN ' invalid values is ' || CAST(p_size AS VARCHAR) || '.' ELSE '' END AS note FROM part""",
)
def d4_flatten_notes(spark, sf_dir):
    notes = """map('label', p_type, 'description', p_brand || '/' || p_name, 'values', p_brand || '/' || p_type,
      'invalid values', CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS STRING) || '/' || p_name END)"""
    parts = table(spark, sf_dir, "part").withColumn("notes", F.expr(notes))
    return D.flatten_notes(parts, "p_name", "notes").select("p_partkey", "note")


@query(
    "d5_transcript",
    """SELECT conv_id, CAST(floor(turn / 500) AS BIGINT) AS part, string_agg(CASE role WHEN 'user' THEN 'Q: ' || text ELSE 'A: ' || text || chr(10) END, chr(10) ORDER BY turn) AS text
FROM conversations WHERE role IN ('user', 'assistant') GROUP BY ALL""",
)
def d5_transcript(spark, sf_dir):
    return D.transcript(table(spark, sf_dir, "conversations"), "conv_id", "turn", 500)


@query(
    "d5_transcript_lines",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Q: ' || text ELSE 'A: ' || text || chr(10) END AS line FROM conversations WHERE role IN ('user', 'assistant')""",
)
def d5_transcript_lines(spark, sf_dir):
    return D.transcript_lines(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "line")


@query(
    "d6_questions",
    """SELECT conv_id, CAST(floor(turn / 500) AS BIGINT) AS part, string_agg(text, chr(10) ORDER BY turn) AS text
FROM conversations WHERE role = 'user' GROUP BY ALL""",
)
def d6_questions(spark, sf_dir):
    return D.questions(table(spark, sf_dir, "conversations"), "conv_id", "turn", 500)


@query(
    "d7_distinct_lines",
    with_views("dv_part") + """SELECT min(p_partkey) AS first, concat_ws('|', type_nullable, CAST(size_nullable AS VARCHAR), list_text) AS line FROM dv_part GROUP BY 2""",
)
def d7_distinct_lines(spark, sf_dir):
    return D.distinct_lines(view(spark, sf_dir, "dv_part"), "p_partkey", ["type_nullable", "size_nullable", "list_text"])


BLOCKS_SQL = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<(script|style)[^>]*>.*?</(script|style)>', chr(10), 'g'), '(?s)<!--.*?-->', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"""


@query(
    "w1_main_text",
    rf"""WITH b AS (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, {BLOCKS_SQL} AS bs FROM pages),
u AS (SELECT page_id, host, unnest(bs) AS block, unnest(range(1, len(bs) + 1)) AS place FROM b),
seen AS (SELECT host, block, count(DISTINCT page_id) AS n FROM u GROUP BY ALL),
sizes AS (SELECT host, count(*) AS total FROM b GROUP BY host),
rep AS (SELECT host, block FROM seen JOIN sizes USING (host) WHERE n >= 3 AND n > total * 0.5),
kept AS (SELECT u.* FROM u ANTI JOIN rep USING (host, block))
SELECT b.page_id, coalesce(string_agg(block, chr(10) ORDER BY place), '') AS text FROM b LEFT JOIN kept USING (page_id) GROUP BY b.page_id""",
)
def w1_main_text(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))


@query(
    "w2_markup_lines",
    r"""SELECT page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(html, '(?s)<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM pages""",
)
def w2_markup_lines(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", W.markup_lines(F.col("html")).alias("text"))


@query("w3_fenced_code", "SELECT conv_id, turn, text AS code FROM conversations")
def w3_fenced_code(spark, sf_dir):
    response = """CASE turn % 3 WHEN 0 THEN 'Here it is:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'Done.'
      WHEN 1 THEN '<think>' || role || '</think><answer>' || text || '</answer>' ELSE text END"""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(response).alias("response"))
    return turns.select("conv_id", "turn", W.fenced_code(F.col("response")).alias("code"))


RESPONSE = """CASE event_id % 4 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```'
  WHEN 1 THEN '{' || chr(10) || '    "refs": "[1, 2]", "in": ' || props || '}' WHEN 2 THEN replace(props, '"', chr(39)) ELSE 'not json: ' || props END"""


@query(
    "w4_lenient_json",
    """SELECT event_id, event_id % 4 <> 3 AS ok, CASE event_id % 4 WHEN 1 THEN CAST(json_extract(props, '$.k') AS BIGINT) WHEN 3 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN event_id % 4 = 1 THEN CAST(2 AS BIGINT) END AS second_ref, CASE WHEN event_id % 4 = 3 THEN 'not json: ' || props END AS text FROM events""",
)
def w4_lenient_json(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select("event_id", W.lenient_json(F.expr(RESPONSE)).alias("p"))
    value = F.col("p.value")
    return parsed.select(
        "event_id",
        "p.ok",
        F.coalesce(
            F.try_variant_get(value, "$.k", "bigint"), F.try_variant_get(value, "$.in.k", "bigint")
        ).alias("k"),
        F.try_variant_get(value, "$.refs[1]", "bigint").alias("second_ref"),
        "p.text",
    )


@query(
    "w5_split_turns",
    """SELECT conv_id, asked, CAST(unnest(range(0, len(ts))) AS INTEGER) AS turn, unnest(ts) AS question FROM (
  SELECT conv_id, turn AS asked, list_filter(string_split(text || '| |' || role || '||' || text, '|'), lambda t: t NOT IN ('', ' ')) AS ts FROM conversations)""",
)
def w5_split_turns(spark, sf_dir):
    joined = table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("asked"), F.expr("text || '| |' || role || '||' || text").alias("question")
    )
    return W.split_turns(joined, "question")


@query(
    "w6_trim_to_format",
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN regexp_replace(text, '^\\n+|\\n+$', '', 'g') ELSE ' ' || regexp_replace(text, '\\n+$', '') END AS answer FROM conversations""".replace("\\\\", "\\"),
)
def w6_trim_to_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.expr("CASE turn % 3 WHEN 0 THEN 'Name it. Format: @text' WHEN 1 THEN 'Name it. Format: @text' || chr(10) ELSE 'Name it.' END").alias("q"),
        F.expr("CASE turn % 3 WHEN 2 THEN text ELSE 'As asked @text ' || text || chr(10) END").alias("a"),
    )
    return turns.select("conv_id", "turn", W.trim_to_format(F.col("q"), F.col("a")).alias("answer"))


@query("w7_line_body", "SELECT conv_id, turn, text AS body FROM conversations")
def w7_line_body(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.expr("'I_0_' || CAST(turn AS STRING) || ' (generated from Q_0_0): ' || text").alias("line")
    )
    return lines.select("conv_id", "turn", W.line_body(F.col("line")).alias("body"))
