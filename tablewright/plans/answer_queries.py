"""Queries over answer frames, sampling, and table readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.cells import comma_number
from tablewright.operators import answers as A
from tablewright.operators import states as St
from tablewright.operators import sampling as M
from tablewright.plans.registry import query, table
from tablewright.plans.views import view, with_views
from tablewright.session import fresh_path
from tablewright.sources.files import (
    keyed_column_notes,
    matched_column_notes,
    read_column_notes,
    read_keyed_json,
    read_labelled_profiles,
    read_metadata,
    read_sidecars,
    read_table,
    write_json,
)
from tablewright.sources.office import read_word_files, read_workbooks, register, table_rows


def sales(spark, sf_dir):
    """Orders with the customer's segment and nation; both lookups are joined by key."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )


SALES_SQL = "WITH sales AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


@query("a1_scalar", "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS answer FROM lineitem")
def a1_scalar(spark, sf_dir):
    value = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return A.scalar(table(spark, sf_dir, "lineitem"), value)


@query(
    "a2_ordered_list",
    "SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) AS position, o_totalprice, o_orderkey FROM orders",
)
def a2_ordered_list(spark, sf_dir):
    return A.ordered_list(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderkey"], descending=True)


@query(
    "a3_ranking",
    SALES_SQL + "SELECT CAST(row_number() OVER (ORDER BY value DESC, n_name) AS INTEGER) AS position, n_name, round(value, 2) AS value FROM (SELECT n_name, sum(o_totalprice) AS value FROM sales GROUP BY 1 ORDER BY value DESC, n_name LIMIT 10)",
)
def a3_ranking(spark, sf_dir):
    return A.ranking(sales(spark, sf_dir), "n_name", F.sum("o_totalprice"), 10).withColumn("value", F.round("value", 2))


@query("a4_series", SALES_SQL + "SELECT CAST(year(o_orderdate) AS INTEGER) AS x, c_mktsegment AS legend, round(sum(o_totalprice), 2) AS y FROM sales GROUP BY ALL")
def a4_series(spark, sf_dir):
    found = A.series(sales(spark, sf_dir), F.year("o_orderdate"), F.sum("o_totalprice"), F.col("c_mktsegment"))
    return found.withColumn("y", F.round("y", 2))


@query(
    "a5_share",
    SALES_SQL + "SELECT x, legend, round(y, 2) AS y, round(y / sum(y) OVER (PARTITION BY x), 6) AS share FROM (SELECT n_name AS x, o_orderstatus AS legend, sum(o_totalprice) AS y FROM sales GROUP BY ALL)",
)
def a5_share(spark, sf_dir):
    found = A.share(sales(spark, sf_dir), F.col("n_name"), F.sum("o_totalprice"), F.col("o_orderstatus"))
    return found.withColumns({"y": F.round("y", 2), "share": F.round("share", 6)})


@query(
    "a6_heatmap",
    with_views("dv_gaps") + "SELECT o_orderpriority, " + ", ".join(
        f"nullif(count(*) FILTER (WHERE status IS NOT DISTINCT FROM {v}), 0) AS \"{n}\"" for v, n in (("'F'", "F"), ("'O'", "O"), ("NULL", "null"))
    ) + " FROM dv_gaps GROUP BY 1",
)
def a6_heatmap(spark, sf_dir):
    return A.heatmap(view(spark, sf_dir, "dv_gaps"), "o_orderpriority", "status", F.count(F.lit(1)), ["F", "O", None])


@query(
    "a6_heatmap_cells",
    with_views("dv_gaps") + "SELECT o_custkey AS x, status AS y, count(*) AS value FROM dv_gaps GROUP BY 1, 2",
)
def a6_heatmap_cells(spark, sf_dir):
    return A.heatmap_cells(view(spark, sf_dir, "dv_gaps"), "o_custkey", "status", F.count(F.lit(1)))


CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "a6_correlation",
    "\nUNION ALL\n".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for a in CORRELATED for b in CORRELATED),
)
def a6_correlation(spark, sf_dir):
    return A.corr_matrix(table(spark, sf_dir, "lineitem"), CORRELATED).withColumn("correlation", F.round("correlation", 6))


@query(
    "a7_five_numbers",
    "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 4) AS {n}" for p, n in zip(A.QUARTILES, A.QUARTILE_NAMES)) + " FROM lineitem GROUP BY 1",
)
def a7_five_numbers(spark, sf_dir):
    found = A.five_numbers(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return found.select("l_returnflag", *[F.round(n, 4).alias(n) for n in A.QUARTILE_NAMES])


@query(
    "a7_sketched_quartiles",
    "\nUNION ALL\n".join(
        f"SELECT l_returnflag, '{n}' AS name, count(l_extendedprice) AS n, min(l_extendedprice) AS smallest, max(l_extendedprice) AS largest, true AS rank_in_bound FROM lineitem GROUP BY 1"
        for n in A.QUARTILE_NAMES[1:4]
    ),
)
def a7_sketched_quartiles(spark, sf_dir):
    """Quartiles from rank sketches; the true rank of each answer is counted and held to its bound."""
    df, names = table(spark, sf_dir, "lineitem"), A.QUARTILE_NAMES
    found = St.sketched_quantiles(df, ["l_returnflag"], "l_extendedprice", A.QUARTILES, names)
    answers = found.select(
        "l_returnflag", "n", F.col(names[0]).alias("smallest"), F.col(names[4]).alias("largest"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("share"), F.col(n).alias("answer")) for n, p in list(zip(names, A.QUARTILES))[1:4]])),
    )
    price, answer, bound = F.col("l_extendedprice"), F.col("answer"), F.lit(St.rank_bound())
    keys = ["l_returnflag", "name", "n", "smallest", "largest", "share"]
    ranks = df.join(answers, "l_returnflag").groupBy(*keys).agg(F.count_if(price < answer).alias("below"), F.count_if(price <= answer).alias("upto"))
    inside = (F.col("below") / F.col("n") <= F.col("share") + bound) & (F.col("upto") / F.col("n") >= F.col("share") - bound)
    return ranks.select("l_returnflag", "name", "n", "smallest", "largest", inside.alias("rank_in_bound"))


PRICED = with_views("dv_gaps") + ", priced AS (SELECT * FROM dv_gaps WHERE isfinite(price))"


@query(
    "a7_five_numbers_gaps",
    PRICED + " SELECT o_orderpriority, " + ", ".join(f"round(quantile_cont(price, {p}), 4) AS {n}" for p, n in zip(A.QUARTILES, A.QUARTILE_NAMES)) + " FROM priced GROUP BY 1",
)
def a7_five_numbers_gaps(spark, sf_dir):
    found = A.five_numbers(view(spark, sf_dir, "dv_gaps"), ["o_orderpriority"], "price")
    return found.select("o_orderpriority", *[F.round(n, 4).alias(n) for n in A.QUARTILE_NAMES])


def doane_sql(t, c):
    return f"""doane AS (SELECT low, high, CAST(CASE WHEN n > 2 AND high > low THEN ceil(1 + log2(n) + log2(1 + abs(m3 / pow(sd, 3)) / sqrt(6.0 * (n - 2) / ((n + 1.0) * (n + 3))))) ELSE 1 END AS INTEGER) AS bins
  FROM (SELECT count(*) AS n, min({c}) AS low, max({c}) AS high, stddev_pop({c}) AS sd, avg(pow({c} - mu, 3)) AS m3 FROM {t}, (SELECT avg({c}) AS mu FROM {t})))"""


BIN_SQL = "CAST(CASE WHEN {c} = high THEN bins ELSE floor(({c} - low) / ((high - low) / bins)) + 1 END AS INTEGER)"


@query(
    "a8_histogram",
    "WITH " + doane_sql("orders", "o_totalprice") + f" SELECT bin, round(low + (bin - 1) * w, 4) AS low, round(low + bin * w, 4) AS high, n FROM (SELECT {BIN_SQL.replace('{c}', 'o_totalprice')} AS bin, low, (high - low) / bins AS w, count(*) AS n FROM orders, doane GROUP BY ALL)",
)
def a8_histogram(spark, sf_dir):
    found = A.histogram(table(spark, sf_dir, "orders"), "o_totalprice")
    return found.withColumns({"low": F.round("low", 4), "high": F.round("high", 4)})


@query(
    "a8_histogram_gaps",
    PRICED + ", " + doane_sql("priced", "price") + f" SELECT bin, round(low + (bin - 1) * w, 4) AS low, round(low + bin * w, 4) AS high, n FROM (SELECT {BIN_SQL.replace('{c}', 'price')} AS bin, low, (high - low) / bins AS w, count(*) AS n FROM priced, doane GROUP BY ALL)",
)
def a8_histogram_gaps(spark, sf_dir):
    found = A.histogram(view(spark, sf_dir, "dv_gaps"), "price")
    return found.withColumns({"low": F.round("low", 4), "high": F.round("high", 4)})


@query(
    "a9_panels",
    "SELECT 'status' AS panel, o_orderstatus AS x, '' AS legend, CAST(count(*) AS DOUBLE) AS y FROM orders GROUP BY ALL UNION ALL SELECT 'year', CAST(year(o_orderdate) AS VARCHAR), o_orderpriority, round(avg(o_totalprice), 4) FROM orders GROUP BY ALL",
)
def a9_panels(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return A.panels([
        ("status", A.series(orders, F.col("o_orderstatus"), F.count(F.lit(1)))),
        ("year", A.series(orders, F.year("o_orderdate"), F.round(F.avg("o_totalprice"), 4), F.col("o_orderpriority"))),
    ])


@query(
    "a10_comma_number",
    with_views("dv_part") + r"SELECT p_partkey, CASE WHEN regexp_matches(replace(sentinel_text, ',', ''), '^[+-]?\d+$') THEN CAST(replace(sentinel_text, ',', '') AS DOUBLE) END AS value FROM dv_part",
)
def a10_comma_number(spark, sf_dir):
    return view(spark, sf_dir, "dv_part").select("p_partkey", comma_number(F.col("sentinel_text")).alias("value"))


@query(
    "a11_null_sentinels",
    with_views("dv_part") + "SELECT p_partkey, CASE WHEN sentinel_text NOT IN ('x', '-', '-99999') THEN sentinel_text END AS sentinel_text FROM dv_part",
)
def a11_null_sentinels(spark, sf_dir):
    return A.null_sentinels(view(spark, sf_dir, "dv_part").select("p_partkey", "sentinel_text"), ["sentinel_text"])


LEVEL = "CASE WHEN p_size % 10 = 0 THEN ' Total' WHEN p_size % 10 = 1 THEN 'ALL' ELSE p_type END"


@query("a12_exclude_totals", f"SELECT * FROM (SELECT p_partkey, {LEVEL} AS level FROM part) WHERE lower(trim(level)) NOT IN ('total', 'all', 'overall')")
def a12_exclude_totals(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.expr(LEVEL).alias("level"))
    return A.exclude_totals(parts, "level")


@query(
    "m1_hash_split",
    "SELECT o_orderkey, CASE WHEN b < 60 THEN 'train' WHEN b < 75 THEN 'validation' ELSE 'test' END AS split FROM (SELECT o_orderkey, ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 4))::INT % 100 AS b FROM orders)",
)
def m1_hash_split(spark, sf_dir):
    return M.hash_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "m2_capped_sample",
    """SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS r FROM events) WHERE r <= 200""",
)
def m2_capped_sample(spark, sf_dir):
    return M.capped_sample(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", 200, "event_id")


@query(
    "m2_capped_many_classes",
    """WITH cap AS (SELECT greatest(1, CAST(floor(200 * 25 / count(DISTINCT o_custkey)::DOUBLE) AS BIGINT)) AS n, count(DISTINCT o_custkey) AS k FROM orders)
SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r FROM orders), cap WHERE r <= CASE WHEN k > 25 THEN n ELSE 200 END""",
)
def m2_capped_many_classes(spark, sf_dir):
    return M.capped_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 200, "o_orderkey")


@query("m3_doane_bins", "WITH " + doane_sql("orders", "o_totalprice") + " SELECT * FROM doane")
def m3_doane_bins(spark, sf_dir):
    return M.doane_bins(table(spark, sf_dir, "orders"), "o_totalprice")


@query(
    "m4_regression_sample",
    "WITH " + doane_sql("orders", "o_totalprice") + f" SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (PARTITION BY {BIN_SQL.replace('{c}', 'o_totalprice')} ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r FROM orders, doane) WHERE r <= 80",
)
def m4_regression_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return M.capped_sample(rows, "o_totalprice", 80, "o_orderkey", task="regression")


@query("m3_doane_bins_gaps", PRICED + ", " + doane_sql("priced", "price") + " SELECT * FROM doane")
def m3_doane_bins_gaps(spark, sf_dir):
    return M.doane_bins(view(spark, sf_dir, "dv_gaps"), "price")


@query(
    "m4_regression_sample_gaps",
    PRICED + ", " + doane_sql("priced", "price") + f""", binned AS (
  SELECT o_orderkey, CASE WHEN isfinite(price) THEN {BIN_SQL.replace('{c}', 'price')} END AS bin FROM dv_gaps, doane)
SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY bin ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r FROM binned) WHERE r <= 80""",
)
def m4_regression_sample_gaps(spark, sf_dir):
    rows = view(spark, sf_dir, "dv_gaps").select("o_orderkey", "price")
    return M.capped_sample(rows, "price", 80, "o_orderkey", task="regression").select("o_orderkey")


@query("s1_read_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment || ', \"' || c_name || '\"' AS note FROM customer")
def s1_read_csv(spark, sf_dir):
    path = fresh_path(spark, "csv")
    rows = table(spark, sf_dir, "customer").withColumn("note", F.expr("c_mktsegment || ', \"' || c_name || '\"'"))
    rows.drop("c_mktsegment").write.option("header", True).option("escape", '"').csv(path)
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, note string"
    return read_table(spark, path, schema=schema)


@query(
    "s1_two_encodings",
    "SELECT c_custkey, c_name || CASE WHEN c_custkey % 2 = 0 THEN ' é' ELSE ' ü' END AS c_name FROM customer",
)
def s1_two_encodings(spark, sf_dir):
    path = fresh_path(spark, "csv")
    rows = table(spark, sf_dir, "customer")
    for kind, even, mark in (("UTF-8", 0, " é"), ("ISO-8859-1", 1, " ü")):
        half = rows.filter(F.col("c_custkey") % 2 == even)
        half.select("c_custkey", F.concat("c_name", F.lit(mark)).alias("c_name")).write.option("header", True).option(
            "encoding", kind
        ).csv(f"{path}/with blank {even}")
    return read_table(spark, [f"{path}/with blank 0", f"{path}/with blank 1"], schema="c_custkey bigint, c_name string")


def keyed_files(rows, path, body, *levels):
    """Write one JSON row to each file under folders named by the levels."""
    rows.select(*levels, F.to_json(body).alias("value")).write.partitionBy(*levels).text(path)


@query(
    "s2_read_metadata",
    "SELECT 'nation=' || CAST(c_nationkey AS VARCHAR) AS path, 'Customers of ' || CAST(c_nationkey AS VARCHAR) AS dataset_title, CASE WHEN c_nationkey % 3 = 0 THEN '<MISSING>' ELSE 'us-pd' END AS license, '' AS publisher FROM customer GROUP BY c_nationkey",
)
def s2_read_metadata(spark, sf_dir):
    path = fresh_path(spark, "metadata")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).distinct()
    body = F.struct(
        F.concat(F.lit("Customers of "), F.col("nation").cast("string")).alias("dataset_title"),
        F.when(F.col("nation") % 3 != 0, "us-pd").otherwise("").alias("license"),
    )
    keyed_files(rows, path, body, "nation")
    return read_metadata(spark, path, "part-*").select("path", "dataset_title", "license", "publisher")


@query(
    "s3_read_keyed_json",
    "SELECT 'status=' || o_orderstatus AS data_source, 'priority=' || substr(o_orderpriority, 1, 1) AS dataset_id, count(*) AS orders FROM orders GROUP BY 1, 2",
)
def s3_read_keyed_json(spark, sf_dir):
    path = fresh_path(spark, "keyed")
    rows = table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderstatus").alias("status"), F.substring("o_orderpriority", 1, 1).alias("priority")
    ).agg(F.count(F.lit(1)).alias("orders"))
    keyed_files(rows, path, F.struct("orders"), "status", "priority")
    return read_keyed_json(spark, path, "part-*", "orders bigint", ["data_source", "dataset_id"])


@query("s4_read_column_notes", "SELECT p_name AS column, any_value(p_type) AS description FROM part GROUP BY p_name HAVING p_name < 'm'")
def s4_read_column_notes(spark, sf_dir):
    path = fresh_path(spark, "notes")
    notes = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.any_value("p_type").alias("description"))
    # one document per table, as wide as its columns
    notes.agg(F.to_json(F.struct(F.struct(F.struct(F.collect_list(F.struct("name", "description")).alias("columns")).alias("view")).alias("meta")))).write.text(path)
    names = [r[0] for r in notes.filter(F.col("name") < "m").select("name").collect()]
    return read_column_notes(spark, path, names)


@query(
    "s6_read_sidecars",
    """SELECT 'txt' AS kind, 'read' AS status, r_name || chr(10) || 'key ' || CAST(r_regionkey AS VARCHAR) AS text FROM region
UNION ALL SELECT 'xml', 'read', r_name || chr(10) || CAST(r_regionkey AS VARCHAR) FROM region
UNION ALL SELECT 'csv', 'read', 'name|key' || chr(10) || r_name || '|' || CAST(r_regionkey AS VARCHAR) FROM region
UNION ALL SELECT 'pdf', 'no reader', NULL FROM region""",
)
def s6_read_sidecars(spark, sf_dir):
    path = fresh_path(spark, "sidecars")
    rows = table(spark, sf_dir, "region")
    name, key = F.col("r_name"), F.col("r_regionkey").cast("string")
    bodies = {
        "txt": F.concat(name, F.lit("\nkey "), key), "xml": F.concat(F.lit("<r><a>"), name, F.lit("</a><b>"), key, F.lit("</b></r>")),
        "csv": F.concat(F.lit("name,key\n"), name, F.lit(","), key), "pdf": F.lit("%PDF"),
    }
    paths = []
    for kind, body in bodies.items():
        rows.select("r_regionkey", body.alias("value")).write.partitionBy("r_regionkey").text(f"{path}/{kind}")
        written = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/{kind}")
        paths += [(kind, r["path"]) for r in written.select("path").collect()]
    found = read_sidecars(spark, [p for _, p in paths], kinds=[k for k, _ in paths])
    return found.select("kind", "status", F.rtrim(F.col("text"), F.lit("\n")).alias("text"))


@query(
    "s4_notes_by_brand",
    "SELECT p_brand AS brand, p_name AS column, min(p_type) AS description FROM part WHERE p_size < 25 GROUP BY 1, 2",
)
def s4_notes_by_brand(spark, sf_dir):
    """One column document for each brand; names come as a table and are joined."""
    path = fresh_path(spark, "notes")
    parts = table(spark, sf_dir, "part").withColumn("brand", F.col("p_brand"))
    # the smallest type is that of the sizes that are asked for
    notes = parts.groupBy("brand", F.col("p_name").alias("name")).agg(
        F.coalesce(F.min(F.when(F.col("p_size") < 25, F.col("p_type"))), F.min("p_type")).alias("description")
    )
    documents = notes.groupBy("brand").agg(F.collect_list(F.struct("name", "description")).alias("columns"))
    body = F.struct(F.struct(F.struct("columns").alias("view")).alias("meta"))
    documents.select("brand", F.to_json(body).alias("value")).write.partitionBy("brand").text(path)
    names = parts.where("p_size < 25").select("brand", F.col("p_name").alias("column"))
    found = matched_column_notes(keyed_column_notes(spark, [f"{path}/*"], ["brand"]), names, ["brand"])
    return found.select("brand", "column", "description")


SUPPLIERS_OF_NATION = """SELECT s_nationkey, CASE WHEN count(*) < 300 THEN
  's_suppkey|s_name|s_acctbal' || chr(10) || string_agg(s_suppkey || '|' || s_name || '|' || s_acctbal, chr(10) ORDER BY s_suppkey) END AS text,
  CASE WHEN count(*) < 300 THEN 'read' ELSE 'too long' END AS status
FROM supplier GROUP BY s_nationkey"""


@query("s5_csv_sidecars", SUPPLIERS_OF_NATION)
def s5_csv_sidecars(spark, sf_dir):
    path = fresh_path(spark, "sidecars")
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_name", "s_acctbal")
    rows.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey").write.partitionBy("s_nationkey").option("header", True).csv(path)
    found = read_sidecars(spark, [f"{path}/*/*"], kinds=["csv"])
    return found.select(F.regexp_extract("path", "s_nationkey=([0-9]+)", 1).cast("int").alias("s_nationkey"), "text", "status")


@query("s6_read_workbooks", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal, s_suppkey % 3 = 0 AS third, DATE '2020-02-27' + CAST(s_suppkey % 400 AS INTEGER) AS since FROM supplier")
def s6_read_workbooks(spark, sf_dir):
    path = fresh_path(spark, "workbooks")
    register(spark)
    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_name", "s_nationkey", "s_acctbal", (F.col("s_suppkey") % 3 == 0).alias("third"),
        F.date_add(F.lit("2020-02-27").cast("date"), (F.col("s_suppkey") % 400).cast("int")).alias("since"),
    )
    rows.repartition(4).write.format("workbook").mode("append").save(path)
    found = table_rows(read_workbooks(spark, path), rows.columns)
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema])


@query(
    "s6_read_word_files",
    "SELECT s_nationkey, string_agg(s_name || chr(9) || s_acctbal, chr(10) ORDER BY s_suppkey) AS text FROM supplier GROUP BY s_nationkey",
)
def s6_read_word_files(spark, sf_dir):
    path = fresh_path(spark, "documents")
    register(spark)
    line = F.struct("s_suppkey", F.concat_ws("\t", "s_name", F.col("s_acctbal").cast("string")).alias("line"))
    texts = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(line)).alias("of"))
    texts.select(F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("name"), F.array_join("of.line", "\n").alias("text")).write.format(
        "wordfile"
    ).mode("append").save(path)
    found = read_word_files(spark, path)
    return found.select(F.regexp_extract("path", "nation ([0-9]+)", 1).cast("int").alias("s_nationkey"), "text")


@query(
    "s7_labelled_profiles",
    "SELECT doc_id, subcategory FROM (SELECT doc_id, CASE quality + 2 * toxic WHEN 0 THEN 'numeric' WHEN 1 THEN 'url' WHEN 2 THEN 'list' ELSE 'other' END AS subcategory FROM labels) WHERE subcategory IN ('url', 'list')",
)
def s7_labelled_profiles(spark, sf_dir):
    path = fresh_path(spark, "labelled")
    label = "CASE quality + 2 * toxic WHEN 0 THEN 'numeric' WHEN 1 THEN 'url' WHEN 2 THEN 'list' ELSE 'other' END"
    table(spark, sf_dir, "labels").select("doc_id", F.expr(label).alias("subcategory")).write.option("header", True).csv(path)
    found = read_labelled_profiles(spark, path, ["url", "list"])
    return found.withColumn("doc_id", F.col("doc_id").cast("bigint"))


@query("s8_write_json", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def s8_write_json(spark, sf_dir):
    path = fresh_path(spark, "json")
    rows = table(spark, sf_dir, "supplier")
    write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)
