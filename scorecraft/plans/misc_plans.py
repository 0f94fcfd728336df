"""Plans for O-08, O-13, O-49, O-93 and O-97, plus the end-to-end tool
evaluation used as a headline bench query."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorecraft.functions.arguments import flatten_arguments, simplify_calls, simplify_filter_keys
from scorecraft.operators import domain as D
from scorecraft.operators import parsing as P
from scorecraft.operators import text_metrics as X
from scorecraft.operators import tool_metrics as T
from scorecraft.plans import parse_plans, text_plans, tool_plans
from scorecraft.plans.fixtures import fixture, fixture_sql
from scorecraft.plans.registry import register
from scorecraft.plans.catalogs import FREIGHT_CATALOG, fixture_catalog
from scorecraft.sources.catalog import catalog_documents, param_enum_dim
from scorecraft.sources.datasets import normalise_legacy


# ------------------------------------------------------------------ O-13
@register("flatten_filter_args", oracle="WITH a AS (" + fixture_sql("filter_args") + ")" + """
, fl AS (""" + tool_plans._FLAT.format(keep="r.record_id", src="a") + """)
, k1 AS (SELECT record_id, regexp_replace(key, '(^|\\.)data_source\\.', '\\1', 'g') AS key, type_tag, str_val, num_val FROM fl)
, k2 AS (SELECT record_id, regexp_replace(key, '(^|\\.)filter\\.(categories|payees)($|\\.)', '\\1filter_\\2\\3', 'g') AS key,
                type_tag, str_val, num_val FROM k1)
SELECT record_id, key, type_tag, str_val, num_val FROM k2 WHERE NOT regexp_matches(key, '(^|\\.)filter\\.')""")
def flatten_filter_args(spark, sf_dir):
    a = fixture(spark, sf_dir, "filter_args")
    return simplify_filter_keys(flatten_arguments(a, ["record_id"], partition_by="record_id")).select(
        "record_id", "key", "type_tag", "str_val", "num_val")


@register("message_filter_rewrite", oracle="WITH a AS (" + fixture_sql("filter_args") + ")" + """
, fl AS (""" + tool_plans._FLAT.format(keep="r.record_id", src="a") + """)
, k1 AS (SELECT record_id, regexp_replace(key, '(^|\\.)data_source\\.', '\\1', 'g') AS key, type_tag, str_val, num_val FROM fl)
, k2 AS (SELECT record_id, regexp_replace(key, '(^|\\.)filter\\.(categories|payees)($|\\.)', '\\1filter_\\2\\3', 'g') AS key,
                type_tag, str_val, num_val FROM k1)
SELECT record_id, key, type_tag, str_val, num_val FROM k2 WHERE NOT regexp_matches(key, '(^|\\.)filter\\.')""")
def message_filter_rewrite(spark, sf_dir):
    """O-13 on the messages' calls, before contexts and ground truth are made."""
    a = fixture(spark, sf_dir, "filter_args")
    calls = F.concat(F.lit('[{"name":"show_pie_chart","arguments":'), F.col("arguments"), F.lit("}]"))
    m = a.select("record_id", simplify_calls(calls).alias("tool_calls"))
    args = m.select("record_id", F.get_json_object("tool_calls", "$[0].arguments").alias("arguments"))
    return flatten_arguments(args, ["record_id"]).select("record_id", "key", "type_tag", "str_val", "num_val")


# ------------------------------------------------------------------ O-08
@register("legacy_turns_normalise", oracle="WITH l AS (" + fixture_sql("legacy_pairs") + """)
SELECT concat(cast(conv_id AS VARCHAR), ':', cast(user_turn AS VARCHAR)) AS conv_id, CAST(0 AS BIGINT) AS turn_idx, 'user' AS role,
       query AS content, CAST(NULL AS VARCHAR) AS tool_name, CAST(NULL AS VARCHAR) AS limit_arg FROM l
UNION ALL
SELECT concat(cast(conv_id AS VARCHAR), ':', cast(user_turn AS VARCHAR)), CAST(1 AS BIGINT), 'assistant',
       CASE WHEN gt_type = 'nlp' THEN answer END,
       CASE WHEN gt_type = 'tool' THEN 'show_pie_chart' END,
       CASE WHEN gt_type = 'tool' THEN cast(answer_turn AS VARCHAR) END FROM l""")
def legacy_turns_normalise(spark, sf_dir):
    lp = fixture(spark, sf_dir, "legacy_pairs")
    tool = F.struct(F.lit("show_pie_chart").alias("tool"),
                    F.parse_json(F.concat(F.lit('{"limit":'), F.col("answer_turn").cast("string"), F.lit("}"))).alias("parameters"))
    gt = F.struct(F.col("gt_type").alias("type"),
                  F.when(F.col("gt_type") == "nlp", F.col("answer")).alias("response"),
                  F.when(F.col("gt_type") == "tool", F.array(tool)).alias("tools"))
    docs = lp.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("user_turn").cast("string")).alias("key"),
                     F.to_json(F.array(F.struct(F.col("query").alias("query"), gt.alias("ground_truth")))).alias("doc"))
    t = normalise_legacy(docs, "doc", "key")
    first = F.get_json_object("tool_calls", "$[0].name")
    return t.select("conv_id", "turn_idx", "role", "content", first.alias("tool_name"),
                    F.get_json_object(F.get_json_object("tool_calls", "$[0].arguments"), "$.limit").alias("limit_arg"))


# ------------------------------------------------------------------ O-97
@register("arg_domain_violations", oracle="WITH pc AS (" + fixture_sql("freight_calls") + """)
, pe(tool, mode, class, param, value) AS (VALUES
    ('book_freight', NULL, NULL, 'mode', 'air'), ('book_freight', NULL, NULL, 'mode', 'sea'),
    ('quote_freight', NULL, NULL, 'mode', 'air'), ('quote_freight', NULL, NULL, 'mode', 'sea'), ('quote_freight', NULL, NULL, 'mode', 'road'),
    ('book_freight', 'sea', NULL, 'ports', 'kobe'), ('book_freight', 'sea', NULL, 'ports', 'oslo'),
    ('book_freight', 'air', NULL, 'ports', 'lima'),
    ('book_freight', 'sea', '1-URGENT', 'box', 'b0'), ('book_freight', 'sea', '1-URGENT', 'box', 'b1'))
, a AS (SELECT record_id, name AS tool, json_extract_string(arguments, '$.mode') AS mode,
               json_extract_string(arguments, '$.class') AS class, arguments FROM pc)
, vals AS (SELECT record_id, tool, mode, class, p.param, 0 AS pos, json_extract_string(arguments, '$.' || p.param) AS value
           FROM a, (VALUES ('mode'), ('class'), ('box')) p(param)
           UNION ALL SELECT record_id, tool, mode, class, 'ports', i, json_extract_string(arguments, '$.ports[' || i || ']')
           FROM a, (VALUES (0), (1)) n(i))
, chk AS (SELECT v.record_id, v.tool, v.param, v.pos, bool_or(pe.value = v.value) AS ok
          FROM vals v JOIN pe ON pe.tool = v.tool AND pe.param = v.param
               AND (pe.mode IS NULL OR pe.mode = v.mode) AND (pe.class IS NULL OR pe.class = v.class)
          GROUP BY 1, 2, 3, 4)
SELECT tool, param, count(*) AS n_values, count(*) FILTER (WHERE NOT ok) AS n_violations FROM chk GROUP BY 1, 2""")
def arg_domain_violations(spark, sf_dir):
    enum = param_enum_dim(catalog_documents(spark, text=FREIGHT_CATALOG))
    return D.arg_domain_violations(fixture(spark, sf_dir, "freight_calls"), enum)


# ------------------------------------------------------------------ O-49
@register("scores_union", oracle=tool_plans._BASE + tool_plans._W2C + tool_plans._EXACT + """
SELECT cast(i.record_id AS VARCHAR) AS record_id, i.gt_type, score_when2call, score_exact_match,
       CAST(NULL AS DOUBLE) AS score_rouge1
FROM items i JOIN w2c USING (record_id) LEFT JOIN exact USING (record_id) WHERE i.gt_type = 'tool'
UNION ALL
SELECT * FROM (""" + text_plans._BASE + """
SELECT i.record_id, i.gt_type, CAST(CASE WHEN i.gt_type = i.pred_type THEN 1.0 ELSE 0.0 END AS DOUBLE), CAST(NULL AS DOUBLE), r1.score_rouge1
FROM items i LEFT JOIN r1 USING (record_id))""")
def scores_union(spark, sf_dir):
    """O-49: tool-bucket rows and text-bucket rows in one table; each bucket's
    metrics are NULL on the other bucket's rows."""
    it = tool_plans.items(spark, sf_dir).filter(F.col("gt_type") == "tool")
    tools, params = fixture_catalog(spark)
    tool_rows = (T.tool_scores_wide(it, tool_plans.calls(spark, sf_dir), tools, params, ["when2call", "exact_match"])
                 .select(F.col("record_id").cast("string").alias("record_id"), "gt_type",
                         "score_when2call", "score_exact_match"))
    tit = text_plans.items(spark, sf_dir)
    text_rows = (T.when2call(tit).join(X.rouge1(X.scorable(tit)), "record_id", "left")
                 .join(tit.select("record_id", "gt_type"), "record_id"))
    return tool_rows.unionByName(text_rows, allowMissingColumns=True).select(
        "record_id", "gt_type", "score_when2call", "score_exact_match", "score_rouge1")


# ------------------------------------------------------------------ O-93
@register("per_item_results", oracle=tool_plans._BASE + tool_plans._W2C + tool_plans._PICKUP + tool_plans._EXACT + """
SELECT fb.record_id, 'tool' AS gt_type, fb.gt_args AS gt_value, fb.pred_type,
       CAST(CASE WHEN fb.pred_type = 'tool' THEN 1 + CASE WHEN fb.record_id % 8 = 0 THEN 1 ELSE 0 END END AS BIGINT) AS n_pred_tools,
       score_when2call, score_tool_pick_up_rate, score_exact_match
FROM fb JOIN w2c USING (record_id) LEFT JOIN pickup USING (record_id) LEFT JOIN exact USING (record_id)""")
def per_item_results(spark, sf_dir):
    """O-93 rows (written by ``scorecraft.sinks.write_per_item_results``)."""
    fb = fixture(spark, sf_dir, "tool_calls")
    it = fb.select("record_id", F.lit("tool").alias("gt_type"), "pred_type", F.lit("").alias("raw_text"))
    calls = tool_plans.calls(spark, sf_dir)
    tools, params = fixture_catalog(spark)
    s = T.tool_scores_wide(it, calls, tools, params, ["when2call", "tool_pick_up_rate", "exact_match"])
    n_pred = calls.filter(F.col("side") == "pred").groupBy("record_id").agg(F.count(F.lit(1)).alias("n_pred_tools"))
    return (s.join(fb.select("record_id", F.col("gt_args").alias("gt_value")), "record_id")
            .join(n_pred, "record_id", "left")
            .select("record_id", "gt_type", "gt_value", "pred_type", "n_pred_tools",
                    "score_when2call", "score_tool_pick_up_rate", "score_exact_match"))


# ------------------------------------------------------------------ end to end
# The parsed form of each answer shape of F-G is known, so the scores follow from it.
_E2E = "WITH fb AS (" + fixture_sql("tool_calls") + "), raw_answers AS (" + fixture_sql("raw_outputs") + """)
, e AS (SELECT record_id, record_id % 9 AS r FROM raw_answers)
, rows AS (SELECT record_id, 'gt' AS side, 0 AS ordinal, gt_tool AS name, gt_args AS arguments FROM fb
           UNION ALL SELECT record_id, 'pred', 0, CASE WHEN r = 2 THEN 'show_line_chart' ELSE 'show_pie_chart' END,
                            CASE WHEN r = 2 THEN '{"metric":"balance"}' ELSE '{"limit":5}' END FROM e WHERE r IN (0, 1, 2, 4, 6))
, items AS (SELECT record_id, 'tool' AS gt_type, CASE WHEN r = 8 THEN 'error' WHEN r IN (3, 5, 7) THEN 'nlp' ELSE 'tool' END AS pred_type FROM e)
, both_tool AS (SELECT record_id FROM items WHERE pred_type = 'tool')
""" + f""", cat(name) AS (VALUES {tool_plans._VALUES_TOOLS})
, params(tool, param) AS (VALUES {tool_plans._VALUES_PARAMS})
""" + tool_plans._W2C + tool_plans._PICKUP + tool_plans._VARIABLE + tool_plans._EXACT


@register("tool_eval_end_to_end", oracle=_E2E + """
SELECT i.record_id, i.gt_type, i.pred_type, score_when2call,
       CAST(CASE WHEN r IN (0, 2, 5, 6, 8) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score_schema_reliability_raw,
       score_schema_reliability_processed,
       score_tool_pick_up_rate, score_tool_hallucination_rate, score_tool_additional_rate,
       score_variable_pickup_rate, score_variable_correct_rate, score_variable_hallucination_rate,
       score_variable_additional_rate, score_exact_match
FROM items i JOIN e USING (record_id) JOIN w2c USING (record_id) JOIN sr USING (record_id) LEFT JOIN pickup USING (record_id)
LEFT JOIN variable USING (record_id) LEFT JOIN exact USING (record_id)""")
def tool_eval_end_to_end(spark, sf_dir):
    """Truth calls (F-B) against parsed free-text answers (F-G): all tool
    metrics, one wide row per record."""
    gt = tool_plans.calls(spark, sf_dir).filter(F.col("side") == "gt")
    parsed = P.parse_outputs(parse_plans.text_responses(spark, sf_dir), "json")
    items = parsed.select("record_id", F.lit("tool").alias("gt_type"), "pred_type", "raw_text", "raw_ok", "pred_tools")
    tools, params = fixture_catalog(spark)
    return T.tool_scores_wide(items, gt, tools, params)
