"""Queries over evaluation, licences and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.text import bpe_token_count, token_count
from tablewright.operators import evaluate as E
from tablewright.operators import licences as L
from tablewright.operators import lineage as G
from tablewright.plans.registry import query, table
from tablewright.plans.views import view, with_views
from tablewright.session import fresh_path

TURN = ["conv_id", "turn"]


def qa_matches(spark, sf_dir):
    qa = view(spark, sf_dir, "dv_qa")
    return E.match_turns(qa.select(*TURN, "pred"), qa.select(*TURN, "target"), TURN)


@query("e1_turn_match", with_views("dv_qa") + "SELECT conv_id, turn, target, pred, pred IS NOT DISTINCT FROM target AS match FROM dv_qa")
def e1_turn_match(spark, sf_dir):
    return qa_matches(spark, sf_dir)


@query("e2_single_accuracy", with_views("dv_qa") + "SELECT count(*) AS turns, round(avg(CAST(pred = target AS INT)), 6) AS single_accuracy FROM dv_qa")
def e2_single_accuracy(spark, sf_dir):
    found = E.qa_accuracy(qa_matches(spark, sf_dir), ["conv_id"])
    return found.select("turns", F.round("single_accuracy", 6).alias("single_accuracy"))


@query(
    "e3_multi_accuracy",
    with_views("dv_qa") + "SELECT count(*) AS questions, round(avg(CAST(ok AS INT)), 6) AS multi_accuracy FROM (SELECT bool_and(pred = target) AS ok FROM dv_qa GROUP BY conv_id)",
)
def e3_multi_accuracy(spark, sf_dir):
    found = E.qa_accuracy(qa_matches(spark, sf_dir), ["conv_id"])
    return found.select("questions", F.round("multi_accuracy", 6).alias("multi_accuracy"))


BEST_SQL = "best AS (SELECT dataset, gt_id, score, pred_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset, gt_id ORDER BY score DESC, pred_id) AS r FROM dv_scores) WHERE r = 1)"


@query("e4_best_match", with_views("dv_scores") + "," + BEST_SQL + " SELECT dataset, gt_id, pred_id, score FROM best")
def e4_best_match(spark, sf_dir):
    return E.best_match(view(spark, sf_dir, "dv_scores"), ["dataset"])


GOLD_SQL = ", gold AS (SELECT o_orderkey % 50 AS dataset, o_orderkey AS gt_id FROM orders)"


@query(
    "e4_best_match_all_gold",
    with_views("dv_scores") + "," + BEST_SQL + GOLD_SQL + " SELECT dataset, gt_id, pred_id, coalesce(score, 0) AS score FROM (SELECT DISTINCT * FROM gold) LEFT JOIN best USING (dataset, gt_id)",
)
def e4_best_match_all_gold(spark, sf_dir):
    gold = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("dataset"), F.col("o_orderkey").alias("gt_id"))
    return E.best_match(view(spark, sf_dir, "dv_scores"), ["dataset"], items=gold)


TOKENS_SQL = r"list_distinct(regexp_extract_all(lower({t}), '[\p{L}\p{N}_]+'))"


def jaccard_sql(a, b):
    left, right = TOKENS_SQL.replace("{t}", a), TOKENS_SQL.replace("{t}", b)
    shared = f"len(list_intersect({left}, {right}))"
    return f"coalesce({shared} / nullif(len({left}) + len({right}) - {shared}, 0)::DOUBLE, 0)"


@query(
    "e5_score_matching",
    f"""WITH gold AS (SELECT conv_id, turn AS gt_id, text AS gt_text, CASE WHEN (conv_id + turn) % 3 = 0 THEN -1 ELSE turn + 1 END AS want FROM conversations WHERE role = 'user'),
sizes AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id),
m AS (SELECT conv_id, gt_id, gt_text, CAST(CASE WHEN want > 0 THEN want ELSE ('0x' || substr(md5(CAST(gt_id AS VARCHAR)), 1, 8))::BIGINT % n + 1 END AS INTEGER) AS pred_index FROM gold JOIN sizes USING (conv_id))
SELECT m.conv_id, gt_id, pred_index, round({jaccard_sql('gt_text', 'p.text')}, 6) AS score FROM m JOIN conversations p ON p.conv_id = m.conv_id AND p.turn + 1 = pred_index""",
)
def e5_score_matching(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter(F.col("role") == "user")
    gold = asked.select("conv_id", F.col("turn").alias("gt_id"), F.col("text").alias("gt_text"))
    pred = turns.select("conv_id", (F.col("turn") + 1).cast("int").alias("pred_index"), F.col("text").alias("pred_text"))
    matching = asked.select(
        "conv_id", F.col("turn").alias("gt_id"),
        F.expr("CAST(CASE WHEN (conv_id + turn) % 3 = 0 THEN -1 ELSE turn + 1 END AS INT)").alias("pred_index"),
    )
    scored = E.score_matching(gold, pred, matching, E.token_jaccard, ["conv_id"])
    return scored.select("conv_id", "gt_id", "pred_index", F.round("score", 6).alias("score"))


@query(
    "e5_score_matching_all_gold",
    f"""WITH gold AS (SELECT conv_id, turn AS gt_id, text AS gt_text, CASE WHEN (conv_id + turn) % 3 <> 0 THEN turn + 1 END AS want FROM conversations WHERE role = 'user'),
pred AS (SELECT conv_id, turn + 1 AS i, text FROM conversations WHERE conv_id % 4 <> 0),
sizes AS (SELECT conv_id, max(i) AS n FROM pred GROUP BY conv_id),
m AS (SELECT conv_id, gt_id, gt_text, CAST(coalesce(want, ('0x' || substr(md5(CAST(gt_id AS VARCHAR)), 1, 8))::BIGINT % n + 1) AS INTEGER) AS pred_index FROM gold LEFT JOIN sizes USING (conv_id))
SELECT m.conv_id, gt_id, pred_index, coalesce(round({jaccard_sql('gt_text', 'p.text')}, 6), 0) AS score FROM m LEFT JOIN pred p ON p.conv_id = m.conv_id AND p.i = pred_index""",
)
def e5_score_matching_all_gold(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter(F.col("role") == "user")
    gold = asked.select("conv_id", F.col("turn").alias("gt_id"), F.col("text").alias("gt_text"))
    pred = turns.filter(F.col("conv_id") % 4 != 0).select(
        "conv_id", (F.col("turn") + 1).cast("int").alias("pred_index"), F.col("text").alias("pred_text")
    )
    matching = asked.filter((F.col("conv_id") + F.col("turn")) % 3 != 0).select(
        "conv_id", F.col("turn").alias("gt_id"), (F.col("turn") + 1).cast("int").alias("pred_index")
    )
    scored = E.score_matching(gold, pred, matching, E.token_jaccard, ["conv_id"])
    return scored.select("conv_id", "gt_id", "pred_index", F.round("score", 6).alias("score"))


@query(
    "e6_expected_rating",
    """SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_linenumber END * exp(-l_quantity / 10)) / sum(exp(-l_quantity / 10)), 6) AS rating
FROM lineitem GROUP BY l_orderkey""",
)
def e6_expected_rating(spark, sf_dir):
    tokens = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.when(F.col("l_returnflag") == "N", "n/a").otherwise(F.col("l_linenumber").cast("string")).alias("token"),
        (-F.col("l_quantity") / 10).alias("logprob"),
    )
    return E.expected_rating(tokens, ["l_orderkey"]).select("l_orderkey", F.round("rating", 6).alias("rating"))


@query(
    "e7_parse_rating",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_retailprice WHEN 2 THEN p_size + 0.5 END::DOUBLE AS rating FROM part",
)
def e7_parse_rating(spark, sf_dir):
    answer = """CASE p_partkey % 4 WHEN 0 THEN 'So <rating>' || CAST(p_size AS STRING) || '</rating>' WHEN 1 THEN CAST(p_retailprice AS STRING)
      WHEN 2 THEN CAST(p_size AS STRING) || '.5' || chr(10) || p_name ELSE p_name END"""
    return table(spark, sf_dir, "part").select("p_partkey", E.parse_rating(F.expr(answer)).alias("rating"))


@query(
    "e8_judge_vote",
    with_views("dv_votes") + "SELECT item_id, count(*) FILTER (WHERE verdict = 'Same') AS same, count(*) FILTER (WHERE verdict = 'Same') >= 3 AS match FROM dv_votes GROUP BY item_id",
)
def e8_judge_vote(spark, sf_dir):
    return E.majority(view(spark, sf_dir, "dv_votes"), ["item_id"])


@query("e9_token_count", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS INTEGER) AS tokens FROM documents")
def e9_token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).alias("tokens"))


@query("e9_bpe_tokens")
def e9_bpe_tokens(spark, sf_dir):
    from public_tokenizers import path

    counted = bpe_token_count(F.col("text"), path("byte_bpe_50k.json"))
    return table(spark, sf_dir, "documents").select("doc_id", counted.alias("tokens"))


@query(
    "e10_dataset_scores",
    with_views("dv_scores") + "," + BEST_SQL + """, summaries AS (SELECT o_orderkey % 50 AS dataset, CAST(count(*) % 11 AS DOUBLE) / 10 AS summary_score FROM orders GROUP BY 1)
SELECT dataset, round(avg(score), 6) AS insight_score, count(*) AS pairs, any_value(summary_score) AS summary_score FROM best LEFT JOIN summaries USING (dataset) GROUP BY dataset""",
)
def e10_dataset_scores(spark, sf_dir):
    best = E.best_match(view(spark, sf_dir, "dv_scores"), ["dataset"])
    summaries = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 50).alias("dataset")).agg(
        ((F.count(F.lit(1)) % 11).cast("double") / 10).alias("summary_score")
    )
    found = E.dataset_scores(best, summaries, ["dataset"])
    return found.withColumn("insight_score", F.round("insight_score", 6))


@query("e11_pair_jaccard", with_views("dv_qa") + f"SELECT conv_id, turn, round({jaccard_sql('question', 'target')}, 6) AS score FROM dv_qa")
def e11_pair_jaccard(spark, sf_dir):
    pairs = view(spark, sf_dir, "dv_qa")
    return pairs.select("conv_id", "turn", F.round(E.token_jaccard(F.col("question"), F.col("target")), 6).alias("score"))


@query(
    "e10_dataset_scores_all",
    with_views("dv_scores") + "," + BEST_SQL + """, summaries AS (SELECT o_orderkey % 60 AS dataset, CAST(count(*) % 11 AS DOUBLE) / 10 AS summary_score FROM orders GROUP BY 1)
SELECT dataset, coalesce(round(avg(score), 6), 0) AS insight_score, count(score) AS pairs, any_value(summary_score) AS summary_score FROM best FULL JOIN summaries USING (dataset) GROUP BY dataset""",
)
def e10_dataset_scores_all(spark, sf_dir):
    best = E.best_match(view(spark, sf_dir, "dv_scores"), ["dataset"])
    summaries = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 60).alias("dataset")).agg(
        ((F.count(F.lit(1)) % 11).cast("double") / 10).alias("summary_score")
    )
    found = E.dataset_scores(best, summaries, ["dataset"])
    return found.withColumn("insight_score", F.round("insight_score", 6))


@query(
    "e11_similar_pairs",
    f"""WITH q AS (SELECT conv_id, turn AS gt_id, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn AS pred_id, text FROM conversations WHERE role <> 'user'),
s AS (SELECT q.conv_id, gt_id, pred_id, {jaccard_sql('q.text', 'a.text')} AS score FROM q JOIN a USING (conv_id))
SELECT conv_id, gt_id, pred_id, round(score, 6) AS score FROM s WHERE score >= 0.1""",
)
def e11_similar_pairs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter(F.col("role") == "user").select("conv_id", F.col("turn").alias("gt_id"), "text")
    told = turns.filter(F.col("role") != "user").select("conv_id", F.col("turn").alias("pred_id"), "text")
    return E.similar_pairs(asked, told, ["conv_id"], 0.1).withColumn("score", F.round("score", 6))


CATEGORY_SQL = """CASE license WHEN 'us-pd' THEN 'ok' WHEN 'Creative Commons Attribution' THEN 'attribution' WHEN 'Creative Commons Attribution Share-Alike' THEN 'sharealike'
  WHEN 'CC-BY-NC-SA-4.0' THEN 'noncommercial' WHEN 'License not specified' THEN 'problem' WHEN '' THEN 'problem' WHEN '<MISSING>' THEN 'problem'
  ELSE CASE WHEN contains(license, 'NC') THEN 'noncommercial' WHEN contains(license, '-SA') THEN 'sharealike' ELSE 'review' END END"""
GROUPS_SQL = f", groups AS (SELECT CASE license WHEN '' THEN '<MISSING>' ELSE license END AS license, {CATEGORY_SQL} AS category, count(*) AS datasets FROM dv_licenses GROUP BY ALL)"


@query("l1_license_category", with_views("dv_licenses") + f"SELECT dataset_key, {CATEGORY_SQL} AS category FROM dv_licenses")
def l1_license_category(spark, sf_dir):
    return view(spark, sf_dir, "dv_licenses").select("dataset_key", L.license_category(F.col("license")).alias("category"))


@query("l2_by_license", with_views("dv_licenses") + GROUPS_SQL + " SELECT * FROM groups")
def l2_by_license(spark, sf_dir):
    return L.by_license(view(spark, sf_dir, "dv_licenses"))


@query(
    "l2_license_items",
    with_views("dv_licenses") + GROUPS_SQL + " SELECT g.license, d.dataset_key, title, publisher, category, datasets FROM dv_licenses d JOIN groups g ON g.license = CASE d.license WHEN '' THEN '<MISSING>' ELSE d.license END",
)
def l2_license_items(spark, sf_dir):
    return L.license_items(view(spark, sf_dir, "dv_licenses"), "dataset_key")


@query(
    "l3_by_category",
    with_views("dv_licenses") + GROUPS_SQL + " SELECT c.category, coalesce(CAST(sum(datasets) AS BIGINT), 0) AS datasets, (SELECT count(*) FROM dv_licenses) AS total FROM (VALUES "
    + ", ".join(f"('{c}')" for c in L.CATEGORIES) + ") c(category) LEFT JOIN groups USING (category) GROUP BY c.category",
)
def l3_by_category(spark, sf_dir):
    return L.by_category(view(spark, sf_dir, "dv_licenses"))


@query("l4_strict_gate", with_views("dv_licenses") + f"SELECT count(*) AS problems, count(*) > 0 AS failed FROM dv_licenses WHERE {CATEGORY_SQL} = 'problem'")
def l4_strict_gate(spark, sf_dir):
    return L.problem_count(view(spark, sf_dir, "dv_licenses"))


@query(
    "l5_license_notices",
    with_views("dv_licenses") + GROUPS_SQL + " SELECT license, category, datasets, CASE category "
    + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in L.NOTICES.items())
    + f" ELSE '' END AS notice, CASE WHEN (SELECT bool_or(category = 'noncommercial') FROM groups) THEN '{L.CORPUS_NOTICE}' ELSE '' END AS corpus_notice FROM groups",
)
def l5_license_notices(spark, sf_dir):
    return L.license_notices(view(spark, sf_dir, "dv_licenses"))


def lineage_inputs(spark, sf_dir):
    refs = view(spark, sf_dir, "dv_refs")
    zero = F.lit(0)
    insights = refs.select(
        "conv_id", G.insight_id(zero, F.col("idx")).alias("id"), G.parse_refs(F.col("reference")).alias("refs"), "insight"
    )
    qa = view(spark, sf_dir, "dv_qa").select(
        "conv_id", G.question_id(zero, F.col("turn")).alias("id"), F.col("question"), F.col("target").alias("answer"),
        F.when(F.col("turn") > 1, F.array(G.insight_id(zero, F.col("turn") - 1))).alias("refs"),
    )
    return qa, insights


REF_SQL = ", refs AS (SELECT conv_id, 'I_0_' || CAST(idx AS VARCHAR) AS id, insight, unnest(regexp_extract_all(reference, '[QI]_\\d+_\\d+')) AS ref FROM dv_refs)"
FOLLOW_SQL = ", follow AS (SELECT conv_id, 'Q_0_' || CAST(turn AS VARCHAR) AS id, 'I_0_' || CAST(turn - 1 AS VARCHAR) AS ref FROM dv_qa WHERE turn > 1)"


@query("g1_parse_refs", with_views("dv_refs") + REF_SQL + " SELECT conv_id, id, ref FROM refs")
def g1_parse_refs(spark, sf_dir):
    _, insights = lineage_inputs(spark, sf_dir)
    return insights.select("conv_id", "id", F.explode("refs").alias("ref"))


NODES_SQL = REF_SQL + FOLLOW_SQL + """, declared AS (
  SELECT conv_id, 'Q_0_' || CAST(turn AS VARCHAR) AS id, 'QA' AS type, question, target AS answer, NULL AS insight FROM dv_qa
  UNION ALL SELECT conv_id, 'I_0_' || CAST(idx AS VARCHAR), 'insight', NULL, NULL, insight FROM dv_refs),
ids AS (SELECT conv_id, id FROM declared UNION SELECT conv_id, ref FROM refs UNION SELECT conv_id, ref FROM follow)
SELECT conv_id, id, type, question, answer, insight FROM ids LEFT JOIN declared USING (conv_id, id)"""
EDGES_SQL = REF_SQL + FOLLOW_SQL + " SELECT DISTINCT conv_id, least(id, ref) AS source, greatest(id, ref) AS target FROM (SELECT conv_id, id, ref FROM refs UNION ALL SELECT conv_id, id, ref FROM follow)"


@query("g2_lineage_nodes", with_views("dv_refs", "dv_qa") + NODES_SQL)
def g2_lineage_nodes(spark, sf_dir):
    return G.lineage_nodes(*lineage_inputs(spark, sf_dir), ["conv_id"])


@query("g3_lineage_edges", with_views("dv_refs", "dv_qa") + EDGES_SQL)
def g3_lineage_edges(spark, sf_dir):
    return G.lineage_edges(*lineage_inputs(spark, sf_dir), ["conv_id"])


@query(
    "g4_lineage_export",
    with_views("dv_refs", "dv_qa") + NODES_SQL.replace("SELECT conv_id, id, type, question, answer, insight FROM ids", ", edges AS (" + EDGES_SQL.removeprefix(REF_SQL + FOLLOW_SQL) + ")\nSELECT conv_id, id, type, question, answer, insight, NULL AS target FROM ids")
    + " UNION ALL SELECT conv_id, source, 'link', NULL, NULL, NULL, target FROM edges",
)
def g4_lineage_export(spark, sf_dir):
    qa, insights = lineage_inputs(spark, sf_dir)
    path = fresh_path(spark, "lineage")
    G.write_lineage(
        G.lineage_nodes(qa, insights, ["conv_id"]), G.lineage_edges(qa, insights, ["conv_id"]), path
    )
    nodes, edges = G.read_lineage(spark, path, "conv_id bigint,")
    none = F.lit(None).cast("string")
    links = edges.select(
        "conv_id", F.col("source").alias("id"), F.lit("link").alias("type"),
        *[none.alias(c) for c in ("question", "answer", "insight")], "target",
    )
    return nodes.withColumn("target", none).unionByName(links)
