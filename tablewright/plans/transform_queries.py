"""Queries over the type-driven column transforms."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tablewright.functions.parts import ABOVE_WORDS, BELOW_WORDS, UNIT_FACTORS, parse_split_spec
from tablewright.operators import transforms as X
from tablewright.plans.registry import query, table
from tablewright.plans.views import view, with_views

DIGITS = r"coalesce(TRY_CAST(regexp_replace({c}, '[^0-9.]', '', 'g') AS DOUBLE), 0)"


def digits(c):
    return DIGITS.replace("{c}", c)


def parts_of(spark, sf_dir, *columns):
    return view(spark, sf_dir, "dv_part").select("p_partkey", *columns)


@query(
    "x1_standardize",
    """SELECT l_orderkey, l_linenumber, l_shipdate,
  round((l_quantity - m1) / s1, 6) AS l_quantity, round((l_extendedprice - m2) / s2, 5) AS l_extendedprice
FROM lineitem, (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_extendedprice) AS m2, stddev_pop(l_extendedprice) AS s2 FROM lineitem)""",
)
def x1_standardize(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice"
    )
    scaled = X.Standardize(["l_quantity", "l_extendedprice"]).fit(rows).transform(rows)
    return scaled.withColumns(
        {"l_quantity": F.round("l_quantity", 6), "l_extendedprice": F.round("l_extendedprice", 5)}
    )


@query(
    "x2_ordinal_encode",
    with_views("dv_part") + """SELECT p_partkey,
  CASE WHEN type_nullable IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY type_nullable NULLS LAST) - 1 END AS type_nullable,
  CASE WHEN size_nullable IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY size_nullable NULLS LAST) - 1 END AS size_nullable FROM dv_part""",
)
def x2_ordinal_encode(spark, sf_dir):
    rows = parts_of(spark, sf_dir, "type_nullable", "size_nullable")
    return X.OrdinalEncode(["type_nullable", "size_nullable"]).fit(rows).transform(rows)


@query(
    "x2_ordinal_encode_many",
    "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_totalprice) - 1 AS o_totalprice FROM orders",
)
def x2_ordinal_encode_many(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return X.OrdinalEncode(["o_totalprice"], inline=100).fit(rows).transform(rows)


@query(
    "x2_ordinal_encode_gaps",
    with_views("dv_gaps") + """, codes AS (SELECT grade, row_number() OVER (ORDER BY grade) - 1 AS code FROM (SELECT DISTINCT grade FROM dv_gaps WHERE isfinite(grade)))
SELECT o_orderkey, CASE WHEN price IS NULL OR NOT isfinite(price) THEN -1 ELSE dense_rank() OVER (ORDER BY CASE WHEN isfinite(price) THEN price END NULLS LAST) - 1 END AS price,
  coalesce(code, -1) AS grade FROM dv_gaps LEFT JOIN codes USING (grade)""",
)
def x2_ordinal_encode_gaps(spark, sf_dir):
    rows = view(spark, sf_dir, "dv_gaps").select("o_orderkey", "price", "grade")
    return X.OrdinalEncode(["price", "grade"], inline=100).fit(rows).transform(rows)


def stamp_parts(stamp, prefix, names=("year", "month", "day", "weekday", "hour", "minute", "second")):
    calls = ("year", "month", "day", "isodow", "hour", "minute", "second")
    return ", ".join(
        f'CAST(date_part(\'{call}\', {stamp}){" - 1" if call == "isodow" else ""} AS INTEGER) AS "{prefix}_{n}"'
        for call, n in zip(calls, names)
    )


@query(
    "x3_date_parts",
    with_views("dv_dates") + r""", read AS (SELECT o_orderkey, o_orderdate, TRY_CAST(iso_text AS TIMESTAMP) AS a,
  CASE WHEN loose_text LIKE '%/%/% %' THEN TRY_CAST(regexp_replace(loose_text, '^(\d+)/(\d+)/(\d+) (.*)$', '\1-\2-\3 \4:00') AS TIMESTAMP)
    WHEN loose_text LIKE '%/%' THEN TRY_CAST(regexp_replace(loose_text, '^(\d+)/(\d+)/(\d+)$', '\3-\1-\2') AS TIMESTAMP)
    ELSE TRY_CAST(regexp_replace(loose_text, '^(\d{4})(\d\d)(\d\d)$', '\1-\2-\3') AS TIMESTAMP) END AS b FROM dv_dates)
SELECT o_orderkey, """ + stamp_parts("o_orderdate", "o_orderdate") + ", " + stamp_parts("a", "iso_text") + ", " + stamp_parts("b", "loose_text") + " FROM read",
)
def x3_date_parts(spark, sf_dir):
    rows = view(spark, sf_dir, "dv_dates").select("o_orderkey", "o_orderdate", "iso_text", "loose_text")
    return X.DateParts(["o_orderdate", "iso_text", "loose_text"], dialect="western").fit(rows).transform(rows)


@query(
    "x3_loose_spellings",
    r"""WITH t AS (SELECT o_orderkey, o_orderdate + (o_orderkey % 86400) * INTERVAL 1 SECOND AS moment FROM orders), s AS (SELECT o_orderkey, CASE o_orderkey % 6
    WHEN 0 THEN strptime(strftime(moment, '%m/%d/%Y %I:%M:%S %p'), '%m/%d/%Y %I:%M:%S %p') WHEN 1 THEN strptime(strftime(moment, '%Y-%m-%d %I:%M %p'), '%Y-%m-%d %I:%M %p')
    WHEN 2 THEN strptime(strftime(moment, '%Y'), '%Y') WHEN 3 THEN strptime(strftime(moment, '%b %Y'), '%b %Y') WHEN 4 THEN strptime(strftime(moment, '%m/%d/%y'), '%m/%d/%y')
    ELSE strptime(strftime(moment, '%a, %d %b %Y'), '%a, %d %b %Y') END AS loose FROM t)
SELECT o_orderkey, """ + stamp_parts("loose", "loose") + " FROM s",
)
def x3_loose_spellings(spark, sf_dir):
    spelled = F.expr("""CASE o_orderkey % 6 WHEN 0 THEN date_format(at, 'MM/dd/yyyy hh:mm:ss a') WHEN 1 THEN date_format(at, 'yyyy-MM-dd h:mm a')
      WHEN 2 THEN date_format(at, 'yyyy') WHEN 3 THEN date_format(at, 'MMM yyyy') WHEN 4 THEN date_format(at, 'MM/dd/yy')
      ELSE date_format(at, 'E, dd MMM yyyy') END""")
    at = F.expr("o_orderdate + make_interval(0, 0, 0, 0, 0, 0, o_orderkey % 86400)")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", at.alias("at")).select("o_orderkey", spelled.alias("loose"))
    return X.DateParts(["loose"], dialect="western").fit(rows).transform(rows)


JP = ("年", "月", "日", "曜日", "時", "分", "秒")


@query(
    "x4_era_dates",
    with_views("dv_dates") + r""", read AS (SELECT o_orderkey, o_orderdate AS a,
  CASE o_orderkey % 6 WHEN 5 THEN o_orderdate + INTERVAL 545 MINUTE ELSE o_orderdate END AS b FROM dv_dates)
SELECT o_orderkey, """ + stamp_parts("a", "era_text", JP) + ", " + stamp_parts("b", "era_mixed", JP) + " FROM read",
)
def x4_era_dates(spark, sf_dir):
    rows = view(spark, sf_dir, "dv_dates").select("o_orderkey", "era_text", "era_mixed")
    return X.DateParts(["era_text", "era_mixed"], dialect="japanese").fit(rows).transform(rows)


@query(
    "x5_date_dialect",
    with_views("dv_dates") + "SELECT o_orderkey, " + stamp_parts("TRY_CAST(iso_text AS TIMESTAMP)", "iso_text") + ", "
    + stamp_parts("o_orderdate", "era_text", JP) + " FROM dv_dates",
)
def x5_date_dialect(spark, sf_dir):
    rows = view(spark, sf_dir, "dv_dates").select("o_orderkey", "iso_text", "era_text")
    return X.DateParts(["iso_text", "era_text"], key="o_orderkey").fit(rows).transform(rows)


@query(
    "x5_late_era_date",
    with_views("dv_dates") + "SELECT o_orderkey, " + stamp_parts("CASE WHEN o_orderkey % 997 = 0 THEN o_orderdate ELSE TRY_CAST(iso_text AS TIMESTAMP) END", "mixed", JP) + " FROM dv_dates",
)
def x5_late_era_date(spark, sf_dir):
    rows = view(spark, sf_dir, "dv_dates").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 997 = 0 THEN era_text ELSE iso_text END AS mixed")
    return X.DateParts(["mixed"]).fit(rows).transform(rows)


@query(
    "x6_tfidf",
    r"""WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(
    regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\p{Nd}+', 'num', 'g'), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
per AS (SELECT doc_id, term, count(*) AS n FROM tok GROUP BY ALL),
voc AS (SELECT term, sum(n) AS uses, count(*) AS docs FROM per GROUP BY term ORDER BY uses DESC, term LIMIT 100),
raw AS (SELECT doc_id, term, n * (ln((1 + (SELECT count(*) FROM documents)) / (1 + docs)::DOUBLE) + 1) AS w FROM per JOIN voc USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw""",
)
def x6_tfidf(spark, sf_dir):
    return X.tfidf_rows(table(spark, sf_dir, "documents"), "text", "doc_id").withColumn(
        "weight", F.round("weight", 6)
    )


@query(
    "x7_url_parts",
    r"""WITH u AS (SELECT page_id, regexp_extract(url, '^(?:([^:/?#]+):)?(//([^/?#]*))?([^?#]*)', 3) AS auth,
  regexp_replace(regexp_extract(url, '^(?:([^:/?#]+):)?(//([^/?#]*))?([^?#]*)', 4), ';[^/]*$', '') AS path FROM pages),
d AS (SELECT page_id, path, CASE WHEN regexp_matches(auth, '^www.') THEN replace(auth, 'www.', '') ELSE auth END AS dom FROM u)
SELECT page_id, CASE WHEN dom = '' THEN 'example.com' ELSE dom END AS "url_Domain",
  CASE WHEN dom = '' THEN '/example/example/' ELSE path END AS "url_Path",
  CASE WHEN dom = '' THEN 'example' WHEN path = '' THEN 'NA' ELSE string_split(path, '/')[-1] END AS "url_LastPath",
  CAST(CASE WHEN dom = '' THEN 3 ELSE len(list_filter(string_split(path, '/'), lambda x: x <> '')) END AS INTEGER) AS "url_Depth" FROM d""",
)
def x7_url_parts(spark, sf_dir):
    return X.UrlParts(["url"]).transform(table(spark, sf_dir, "pages").select("page_id", "url"))


LIST_SQL = r"list_filter(regexp_split_to_array(regexp_replace({c}, '^\[+|\]+$|''', '', 'g'), '[^0-9a-zA-Z_-]+'), lambda e: e <> '')"


def _list_sql(c):
    return LIST_SQL.replace("{c}", c)


@query(
    "x8_list_multi_hot",
    with_views("dv_part") + f", e AS (SELECT p_partkey, {_list_sql('list_text')} AS es FROM dv_part)"
    + " SELECT p_partkey, CAST(sum(h) AS BIGINT) AS hot, string_agg(v, '|' ORDER BY v) FILTER (WHERE h = 1) AS names FROM ("
    "SELECT p_partkey, v, CASE WHEN list_contains(es, v) THEN 1 ELSE 0 END AS h FROM e, (SELECT DISTINCT unnest(es) AS v FROM e)) GROUP BY p_partkey",
)
def x8_list_multi_hot(spark, sf_dir):
    rows = parts_of(spark, sf_dir, "list_text")
    model = X.ListColumns(["list_text"]).fit(rows)
    hot = model.transform(rows)
    values = model.getState()["list_text"]["values"]
    flags = [F.col(f"`list_text_{v}`") for v in values]
    named = [F.when(f == 1, F.lit(v)) for f, v in zip(flags, values)]
    return hot.select(
        "p_partkey",
        F.aggregate(F.array(*flags), F.lit(0), lambda a, x: a + x).cast("bigint").alias("hot"),
        F.concat_ws("|", *named).alias("names"),
    )


@query(
    "x9_list_fixed",
    with_views("dv_part") + f", e AS (SELECT p_partkey, {_list_sql('wide_list_text')} AS es FROM dv_part)"
    + " SELECT p_partkey, es[1] AS wide_list_text_0, es[2] AS wide_list_text_1, es[3] AS wide_list_text_2 FROM e",
)
def x9_list_fixed(spark, sf_dir):
    rows = parts_of(spark, sf_dir, "wide_list_text")
    return X.ListColumns(["wide_list_text"], max_elements=100).fit(rows).transform(rows)


@query("x10_list_text", "SELECT doc_id, text AS text_as_sentence FROM documents")
def x10_list_text(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return X.ListColumns(["text"], max_elements=100).fit(rows).transform(rows)


@query("x11_drop", "SELECT p_partkey, p_name FROM part")
def x11_drop(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return X.DropColumns(["p_brand", "p_type"]).transform(rows)


@query(
    "x12_embedded_number",
    with_views("dv_part") + f"SELECT p_partkey, {digits('embed_text')} AS embed_text, {digits('code_text')} AS code_text FROM dv_part",
)
def x12_embedded_number(spark, sf_dir):
    rows = parts_of(spark, sf_dir, "embed_text", "code_text")
    return X.EmbeddedNumber(["embed_text", "code_text"]).transform(rows)


UNIT_CASE = " ".join(f"WHEN '{u}' THEN {float(f)}" for u, f in UNIT_FACTORS.items())


@query(
    "x13_unit_number",
    with_views("dv_part") + f"""SELECT p_partkey, {digits('unit_text')} * CASE trim(regexp_replace(unit_text, '[0-9.]+', '', 'g')) {UNIT_CASE} ELSE 1.0 END AS unit_text,
  {digits('one_unit_text')} AS one_unit_text FROM dv_part""",
)
def x13_unit_number(spark, sf_dir):
    rows = parts_of(spark, sf_dir, "unit_text", "one_unit_text")
    return X.UnitNumber(["unit_text", "one_unit_text"]).fit(rows).transform(rows)


def quoted(words):
    return ", ".join(f"'{w}'" for w in words)


@query(
    "x14_sign_number",
    with_views("dv_part") + f"""SELECT p_partkey, {digits('one_unit_text')} AS one_unit_text, {digits('sign_text')} + CASE
  WHEN lower(trim(regexp_replace(sign_text, '\\d+(\\.\\d+)?', '', 'g'))) IN ({quoted(BELOW_WORDS)}) THEN -1
  WHEN lower(trim(regexp_replace(sign_text, '\\d+(\\.\\d+)?', '', 'g'))) IN ({quoted(ABOVE_WORDS)}) THEN 1 ELSE 0 END AS sign_text FROM dv_part""",
)
def x14_sign_number(spark, sf_dir):
    rows = parts_of(spark, sf_dir, "sign_text", "one_unit_text")
    return X.SignNumber(["sign_text", "one_unit_text"]).fit(rows).transform(rows)


@query(
    "x15_range_number",
    with_views("dv_part") + r"""SELECT p_partkey,
  CAST(coalesce(nullif(regexp_extract(range_text, '(-?\d*\.?\d+)\D+(-?\d*\.?\d+)', 1), ''), range_text) AS DOUBLE) AS range_text_start,
  CAST(coalesce(nullif(regexp_extract(range_text, '(-?\d*\.?\d+)\D+(-?\d*\.?\d+)', 2), ''), range_text) AS DOUBLE) AS range_text_end,
  """ + digits("no_range_text") + " AS no_range_text_no_change FROM dv_part",
)
def x15_range_number(spark, sf_dir):
    rows = parts_of(spark, sf_dir, "range_text", "no_range_text")
    return X.RangeNumber(["range_text", "no_range_text"]).fit(rows).transform(rows)


SPLIT_COLUMNS = ["code_text", "range_text", "list_text", "wide_list_text", "p_type", "embed_text"]


def _split_arm(c):
    runs = f"regexp_extract_all({c}, '[^0-9a-zA-Z.]+')"
    return f"""SELECT '{c}' AS column_name, CASE WHEN lo = hi AND hi > 1 THEN sep END AS separator,
  CAST(CASE WHEN lo = hi AND hi > 1 THEN hi ELSE 1 END AS INTEGER) AS parts FROM (
  SELECT min(k) AS lo, max(k) AS hi, (SELECT sep FROM (SELECT list_sort(list_transform(list_distinct(runs), lambda r: {{'n': -len(list_filter(runs, lambda o: o = r)), 'at': list_position(runs, r), 'r': r}}))[1].r AS sep
     FROM (SELECT {runs} AS runs FROM dv_part) WHERE len(runs) > 1) GROUP BY sep ORDER BY count(*) DESC, sep LIMIT 1) AS sep
  FROM (SELECT CASE WHEN len(runs) > 1 THEN len(string_split({c}, list_sort(list_transform(list_distinct(runs), lambda r: {{'n': -len(list_filter(runs, lambda o: o = r)), 'at': list_position(runs, r), 'r': r}}))[1].r)) ELSE 1 END AS k
    FROM (SELECT {c}, {runs} AS runs FROM dv_part)))"""


@query("x16_detect_split", with_views("dv_part") + "\nUNION ALL\n".join(_split_arm(c) for c in SPLIT_COLUMNS))
def x16_detect_split(spark, sf_dir):
    found = X.detect_splits(view(spark, sf_dir, "dv_part"), SPLIT_COLUMNS)
    return found.select(F.col("column").alias("column_name"), "separator", "parts")


@query(
    "x17_split_text",
    with_views("dv_part") + "SELECT p_partkey, " + ", ".join(
        f"coalesce(string_split(code_text, '-')[{i + 1}], '') AS code_text_{i}" for i in range(4)
    ) + " FROM dv_part",
)
def x17_split_text(spark, sf_dir):
    return X.split_by_text(parts_of(spark, sf_dir, "code_text"), "code_text", "-", 4)


@query(
    "x18_split_offsets",
    with_views("dv_part") + "SELECT p_partkey, substr(code_text, 1, 3) AS code_text_0, substr(code_text, 4, 2) AS code_text_1, substr(code_text, 6) AS code_text_2 FROM dv_part",
)
def x18_split_offsets(spark, sf_dir):
    return X.split_by_offsets(parts_of(spark, sf_dir, "code_text"), "code_text", [3, 5])


@query(
    "x19_split_number_text",
    with_views("dv_part") + r"SELECT p_partkey, regexp_replace(embed_text, '[^0-9.]', '', 'g') AS embed_text_num, regexp_replace(embed_text, '\d+(\.\d+)?', '', 'g') AS embed_text_str FROM dv_part",
)
def x19_split_number_text(spark, sf_dir):
    return X.split_number_text(parts_of(spark, sf_dir, "embed_text"), "embed_text")


@query(
    "x20_cast_if_numeric",
    with_views("dv_part") + "SELECT p_partkey, CAST(p_size AS DOUBLE) AS size_text, mixed_text FROM dv_part",
)
def x20_cast_if_numeric(spark, sf_dir):
    rows = view(spark, sf_dir, "dv_part").select(
        "p_partkey", F.col("p_size").cast("string").alias("size_text"), "mixed_text"
    )
    return X.CastIfNumeric(["size_text", "mixed_text"]).fit(rows).transform(rows)


@query(
    "x21_drop_constant",
    with_views("dv_part") + r"SELECT p_partkey, regexp_replace(one_unit_text, '[^0-9.]', '', 'g') AS one_unit_text_num FROM dv_part",
)
def x21_drop_constant(spark, sf_dir):
    rows = X.split_number_text(parts_of(spark, sf_dir, "one_unit_text"), "one_unit_text")
    return X.DropConstant(["one_unit_text_num", "one_unit_text_str"]).fit(rows).transform(rows)


SPEC = """CASE p_partkey % 5
  WHEN 0 THEN 'Option: 1' || chr(10) || 'Reason: fixed widths' || chr(10) || 'Where to split: [' || CAST(p_size AS STRING) || ', ' || CAST(p_size + 4 AS STRING) || ']'
  WHEN 1 THEN 'Option: 2' || chr(10) || 'Reason: one mark' || chr(10) || 'Where to split: [''-'']'
  WHEN 2 THEN 'Option: 3' || chr(10) || 'Reason: none' || chr(10) || 'Where to split: nowhere'
  WHEN 3 THEN 'Option: 1' || chr(10) || 'Reason: odd' || chr(10) || 'Where to split: [a, b]'
  ELSE 'Option: 2' || chr(10) || 'Reason: long' || chr(10) || 'Where to split: [' || p_name || p_type || p_name || ']' END"""


@query(
    "x22_split_spec",
    """SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 3
  ELSE CASE WHEN length(p_name || p_type || p_name) + 2 > 20 THEN 4 ELSE 2 END END AS INTEGER) AS option,
  CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size AS VARCHAR) || ',' || CAST(p_size + 4 AS VARCHAR) END AS offsets,
  CASE WHEN p_partkey % 5 = 1 THEN '-' WHEN p_partkey % 5 = 4 AND length(p_name || p_type || p_name) + 2 <= 20 THEN p_name || p_type || p_name END AS separator FROM part""",
)
def x22_split_spec(spark, sf_dir):
    specs = table(spark, sf_dir, "part").select("p_partkey", F.expr(SPEC).alias("spec"))
    spec = specs.select("p_partkey", parse_split_spec(F.col("spec")).alias("s"))
    return spec.select(
        "p_partkey",
        "s.option",
        F.array_join(F.col("s.offsets").cast("array<string>"), ",").alias("offsets"),
        "s.separator",
    )


INTERLEAVED = ["mixed_text", "p_type", "sentinel_text"]
PLAIN = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


def _interleaved_arm(c):
    return f"""SELECT '{c}' AS column_name, list_transform(range(0, 5), lambda i: s[(i % len(s)) + 1]) AS s FROM (
  SELECT CASE WHEN len(nums) > 0 AND len(strs) > 0 THEN flatten(list_transform(range(0, least(3, greatest(len(nums), len(strs)))),
      lambda i: [strs[CASE WHEN len(nums) > len(strs) THEN i % len(strs) ELSE i END + 1], nums[CASE WHEN len(nums) > len(strs) THEN i ELSE i % len(nums) END + 1]]))
    WHEN len(nums) > 0 THEN nums ELSE strs END AS s FROM (
  SELECT coalesce(list(CAST(CAST(trunc(TRY_CAST({c} AS DOUBLE)) AS BIGINT) AS VARCHAR) ORDER BY p_partkey) FILTER (WHERE regexp_matches({c}, {PLAIN})), []) AS nums,
    coalesce(list({c} ORDER BY p_partkey) FILTER (WHERE NOT regexp_matches({c}, '^\\d+$')), []) AS strs FROM dv_part))"""


@query(
    "x23_interleaved_samples",
    with_views("dv_part") + "SELECT column_name, " + ", ".join(f"s[{i}] AS sample_{i}" for i in range(1, 6))
    + " FROM (" + "\nUNION ALL\n".join(_interleaved_arm(c) for c in INTERLEAVED) + ")",
)
def x23_interleaved_samples(spark, sf_dir):
    rows = view(spark, sf_dir, "dv_part")
    out = None
    for c in INTERLEAVED:
        one = X.interleaved_samples(rows, c, "p_partkey").select(
            F.lit(c).alias("column_name"), *[F.col("samples")[i].alias(f"sample_{i + 1}") for i in range(5)]
        )
        out = one if out is None else out.unionByName(one)
    return out


@query("x24_unchanged", with_views("dv_part") + "SELECT p_partkey, code_text AS code_text_unchanged FROM dv_part")
def x24_unchanged(spark, sf_dir):
    rows = parts_of(spark, sf_dir, "code_text")
    return X.FormattedId(["code_text"], specs={"code_text": {"option": 3}}).fit(rows).transform(rows)


@query(
    "x16_formatted_id",
    with_views("dv_part") + r"""SELECT p_partkey, string_split(code_text, '-')[1] AS code_text_0, CAST(string_split(code_text, '-')[2] AS DOUBLE) AS code_text_1,
  CAST(string_split(code_text, '-')[3] AS DOUBLE) AS code_text_2, CAST(regexp_replace(embed_text, '[^0-9.]', '', 'g') AS DOUBLE) AS embed_text_num FROM dv_part""",
)
def x16_formatted_id(spark, sf_dir):
    rows = parts_of(spark, sf_dir, "code_text", "embed_text")
    return X.FormattedId(["code_text", "embed_text"]).fit(rows).transform(rows)


@query(
    "x25_mode_impute",
    with_views("dv_part") + """SELECT p_partkey,
  coalesce(type_nullable, (SELECT type_nullable FROM dv_part WHERE type_nullable IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS type_nullable,
  coalesce(size_nullable, (SELECT size_nullable FROM dv_part WHERE size_nullable IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS size_nullable FROM dv_part""",
)
def x25_mode_impute(spark, sf_dir):
    rows = parts_of(spark, sf_dir, "type_nullable", "size_nullable")
    return X.ModeImpute(["type_nullable", "size_nullable"]).fit(rows).transform(rows)


@query(
    "x25_mode_impute_gaps",
    with_views("dv_gaps") + """, ties AS (SELECT DISTINCT long_text, 1 AS n FROM dv_gaps)
SELECT n, coalesce(long_text, (SELECT min(long_text) FROM ties)) AS long_text FROM ties""",
)
def x25_mode_impute_gaps(spark, sf_dir):
    rows = view(spark, sf_dir, "dv_gaps").select("long_text").distinct().withColumn("n", F.lit(1))
    return X.ModeImpute(["long_text"]).fit(rows).transform(rows)


@query(
    "x26_chain",
    with_views("dv_part") + f"""SELECT p_partkey, {digits('embed_text')} AS embed_text,
  {digits('unit_text')} * CASE trim(regexp_replace(unit_text, '[0-9.]+', '', 'g')) {UNIT_CASE} ELSE 1.0 END AS unit_text,
  CAST(coalesce(nullif(regexp_extract(range_text, '(-?\\d*\\.?\\d+)\\D+(-?\\d*\\.?\\d+)', 1), ''), range_text) AS DOUBLE) AS range_text_start,
  CAST(coalesce(nullif(regexp_extract(range_text, '(-?\\d*\\.?\\d+)\\D+(-?\\d*\\.?\\d+)', 2), ''), range_text) AS DOUBLE) AS range_text_end FROM dv_part""",
)
def x26_chain(spark, sf_dir):
    rows = parts_of(spark, sf_dir, "embed_text", "unit_text", "range_text", "p_type")
    stages = [
        X.EmbeddedNumber(["embed_text"]),
        X.UnitNumber(["unit_text"]),
        X.RangeNumber(["range_text"]),
        X.DropColumns(["p_type"]),
    ]
    return Pipeline(stages=stages).fit(rows).transform(rows)
