"""Plans over tool calls (fixture F-B): O-03/O-04, O-48, O-55..68."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorecraft.functions.arguments import flatten_arguments, values_match
from scorecraft.operators import tool_metrics as T
from scorecraft.plans.fixtures import fixture, fixture_sql
from scorecraft.plans.registry import register
from scorecraft.plans.catalogs import fixture_catalog

CHART_TOOLS = ("show_pie_chart", "show_stacked_bar_chart", "show_line_chart")


def items(spark, sf_dir):
    """Tool ground truths from F-B (native calls: raw text is '') plus text
    ground truths from F-D (an empty prediction parses to an error)."""
    fb = fixture(spark, sf_dir, "tool_calls")
    tool = fb.select("record_id", F.lit("tool").alias("gt_type"), "pred_type", F.lit("").alias("raw_text"))
    fd = fixture(spark, sf_dir, "text_pairs")
    text = fd.select((-(F.col("conv_id") * 1000 + F.col("turn")) - 1).alias("record_id"), F.lit("nlp").alias("gt_type"),
                     F.when(F.col("prediction_text") == "", "error").otherwise("nlp").alias("pred_type"),
                     F.col("prediction_text").alias("raw_text"))
    return tool.unionByName(text)


def calls(spark, sf_dir):
    return fixture(spark, sf_dir, "tool_call_rows")


# ---------------------------------------------------------------- DuckDB side
_VALUES_TOOLS = ", ".join(f"('{t}')" for t in CHART_TOOLS)
_VALUES_PARAMS = ", ".join(f"('{t}', '{p}')" for t in CHART_TOOLS for p in ("data_source", "payees", "title"))

_BASE = ("WITH fb AS (" + fixture_sql("tool_calls") + "), rows AS (" + fixture_sql("tool_call_rows") + ")"
         + ", fd AS (" + fixture_sql("text_pairs") + ")" + f"""
, items AS (SELECT record_id, 'tool' AS gt_type, pred_type FROM fb
            UNION ALL SELECT -(conv_id * 1000 + turn) - 1, 'nlp', CASE WHEN prediction_text = '' THEN 'error' ELSE 'nlp' END FROM fd)
, both_tool AS (SELECT record_id FROM items WHERE gt_type = 'tool' AND pred_type = 'tool')
, cat(name) AS (VALUES {_VALUES_TOOLS})
, params(tool, param) AS (VALUES {_VALUES_PARAMS})
""")

# Leaf rows of an argument document (json_tree), typed like the Spark side.
_FLAT = """
SELECT {keep}, substr(jt.fullkey, 3) AS key, split_part(substr(jt.fullkey, 3), '.', 1) AS base_key,
       CASE jt.type WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null'
                    WHEN 'ARRAY' THEN 'list' ELSE 'num' END AS type_tag,
       CASE WHEN jt.type = 'VARCHAR' THEN json_extract_string(jt.value, '$')
            WHEN jt.type = 'ARRAY' THEN replace(CAST(jt.value AS VARCHAR), ',', ', ') END AS str_val,
       CASE WHEN jt.type = 'BOOLEAN' THEN CASE WHEN CAST(jt.value AS VARCHAR) = 'true' THEN 1.0 ELSE 0.0 END
            WHEN jt.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(CAST(jt.value AS VARCHAR) AS DOUBLE) END AS num_val
FROM {src} r, json_tree(r.arguments) jt
WHERE jt.type <> 'OBJECT' AND jt.fullkey NOT LIKE '%[%'
  AND NOT list_contains(string_split(substr(jt.fullkey, 3), '.'), 'title')
"""

_MATCH = """CASE WHEN {g}_tag = 'null' OR {p}_tag = 'null' THEN {g}_tag = 'null' AND {p}_tag = 'null'
     WHEN {g}_tag IN ('str', 'list') AND {p}_tag IN ('str', 'list') THEN lower({g}_str) = lower({p}_str)
     WHEN {g}_tag IN ('num', 'bool') AND {p}_tag IN ('num', 'bool') THEN abs({g}_num - {p}_num) < 1e-9
     ELSE false END"""

_PICKUP = """
, names AS (SELECT record_id, coalesce(name, '') AS name, count(*) FILTER (WHERE side = 'gt') AS n_g,
                   count(*) FILTER (WHERE side = 'pred') AS n_p FROM rows GROUP BY 1, 2)
, pu AS (SELECT record_id, sum(n_g) AS n,
           count(*) FILTER (WHERE n_g > 0 AND n_p > 0) AS c,
           count(*) FILTER (WHERE n_p > 0 AND name NOT IN (SELECT name FROM cat)) AS h,
           count(*) FILTER (WHERE n_p > 0 AND name IN (SELECT name FROM cat) AND n_g = 0) AS a
         FROM names GROUP BY record_id)
, pickup AS (SELECT b.record_id,
           coalesce(c, 0) / nullif(coalesce(n, 0), 0) AS score_tool_pick_up_rate,
           coalesce(h, 0) / nullif(coalesce(n, 0), 0) AS score_tool_hallucination_rate,
           coalesce(a, 0) / nullif(coalesce(n, 0), 0) AS score_tool_additional_rate
         FROM both_tool b LEFT JOIN pu USING (record_id))
"""

_VARIABLE = """
, last AS (SELECT * FROM rows QUALIFY ordinal = max(ordinal) OVER (PARTITION BY record_id, side, name))
, lflat AS (""" + _FLAT.format(keep="r.record_id, r.side, r.name", src="last") + """)
, g AS (SELECT record_id, name, key, type_tag AS g_tag, str_val AS g_str, num_val AS g_num FROM lflat WHERE side = 'gt')
, p AS (SELECT record_id, name, key, base_key, type_tag AS p_tag, str_val AS p_str, num_val AS p_num FROM lflat WHERE side = 'pred')
, bn AS (SELECT DISTINCT a.record_id, a.name FROM last a JOIN last b ON a.record_id = b.record_id AND a.name = b.name
         AND a.side = 'gt' AND b.side = 'pred')
, pk AS (SELECT p.*, g.g_tag, g.g_str, g.g_num,
            (p.name, p.base_key) IN (SELECT tool, param FROM params WHERE param <> 'title') AS valid
         FROM p JOIN bn USING (record_id, name) LEFT JOIN g USING (record_id, name, key))
, per_tool AS (SELECT record_id, name,
            count(*) FILTER (WHERE NOT valid) AS h,
            count(*) FILTER (WHERE valid AND g_tag IS NOT NULL) AS k,
            count(*) FILTER (WHERE valid AND g_tag IS NOT NULL AND (""" + _MATCH.format(g="g", p="p") + """)) AS c,
            count(*) FILTER (WHERE valid AND g_tag IS NULL) AS a
         FROM pk GROUP BY 1, 2)
, nk AS (SELECT record_id, name, count(*) AS n_keys FROM g GROUP BY 1, 2)
, rates AS (SELECT bn.record_id,
            coalesce(k, 0) / nullif(coalesce(n_keys, 0), 0) AS k, coalesce(c, 0) / nullif(coalesce(n_keys, 0), 0) AS c,
            coalesce(h, 0) / nullif(coalesce(n_keys, 0), 0) AS h, coalesce(a, 0) / nullif(coalesce(n_keys, 0), 0) AS a
         FROM bn LEFT JOIN per_tool USING (record_id, name) LEFT JOIN nk USING (record_id, name))
, per_rec AS (SELECT record_id, sum(k) AS k, sum(c) AS c, sum(h) AS h, sum(a) AS a,
            count(*) FILTER (WHERE k IS NULL) AS undefined FROM rates GROUP BY 1)
, ngt AS (SELECT record_id, count(*) AS n_gt FROM rows WHERE side = 'gt' GROUP BY 1)
, variable AS (SELECT b.record_id,
            CASE WHEN coalesce(undefined, 0) = 0 THEN coalesce(k, 0.0) / nullif(coalesce(n_gt, 0), 0) END AS score_variable_pickup_rate,
            CASE WHEN coalesce(undefined, 0) = 0 THEN coalesce(c, 0.0) / nullif(coalesce(n_gt, 0), 0) END AS score_variable_correct_rate,
            CASE WHEN coalesce(undefined, 0) = 0 THEN coalesce(h, 0.0) / nullif(coalesce(n_gt, 0), 0) END AS score_variable_hallucination_rate,
            CASE WHEN coalesce(undefined, 0) = 0 THEN coalesce(a, 0.0) / nullif(coalesce(n_gt, 0), 0) END AS score_variable_additional_rate
         FROM both_tool b LEFT JOIN per_rec USING (record_id) LEFT JOIN ngt USING (record_id))
"""

_EXACT = """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY record_id, side ORDER BY coalesce(name, ''), ordinal) AS rank FROM rows)
, cnt AS (SELECT record_id, count(*) FILTER (WHERE side = 'gt') AS n_g, count(*) FILTER (WHERE side = 'pred') AS n_p FROM rows GROUP BY 1)
, nb AS (SELECT a.record_id, count(*) FILTER (WHERE NOT coalesce(a.name = b.name, false)) AS bad_names
         FROM ranked a JOIN ranked b ON a.record_id = b.record_id AND a.rank = b.rank AND a.side = 'gt' AND b.side = 'pred'
         GROUP BY 1)
, rflat AS (""" + _FLAT.format(keep="r.record_id, r.side, r.rank", src="ranked") + """)
, gk AS (SELECT record_id, rank, key, type_tag AS g_tag, str_val AS g_str, num_val AS g_num FROM rflat WHERE side = 'gt')
, pk2 AS (SELECT record_id, rank, key, type_tag AS p_tag, str_val AS p_str, num_val AS p_num FROM rflat WHERE side = 'pred')
, kb AS (SELECT record_id, count(*) FILTER (WHERE p_tag IS NULL OR NOT (""" + _MATCH.format(g="g", p="p") + """)) AS bad_keys
         FROM gk LEFT JOIN pk2 USING (record_id, rank, key) GROUP BY 1)
, exact AS (SELECT b.record_id,
            CAST(CASE WHEN coalesce(n_g, 0) = coalesce(n_p, 0) AND coalesce(bad_names, 0) = 0 AND coalesce(bad_keys, 0) = 0
                 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score_exact_match
         FROM both_tool b LEFT JOIN cnt USING (record_id) LEFT JOIN nb USING (record_id) LEFT JOIN kb USING (record_id))
"""

_W2C = """
, w2c AS (SELECT record_id, CAST(CASE WHEN coalesce(gt_type, 'error') = coalesce(pred_type, 'error') THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score_when2call FROM items)
, sr AS (SELECT record_id, CAST(CASE WHEN gt_type = 'tool' THEN 1.0 END AS DOUBLE) AS score_schema_reliability_raw,
                CAST(CASE WHEN gt_type = 'tool' THEN CASE WHEN pred_type = 'tool' THEN 1.0 ELSE 0.0 END END AS DOUBLE) AS score_schema_reliability_processed
         FROM items)
"""


# -------------------------------------------------------------------- plans
@register("tool_catalog", oracle=_BASE + """
, fl AS (""" + _FLAT.format(keep="r.name", src="rows") + """ AND r.side = 'pred')
SELECT p.tool, p.param, (SELECT count(*) FROM fl WHERE fl.name = p.tool AND fl.base_key = p.param) AS n_pred_uses
FROM params p WHERE p.param <> 'title'""")
def tool_catalog(spark, sf_dir):
    """O-03/O-04: catalogue parameters with how often predictions use them."""
    _, params = fixture_catalog(spark)
    c = calls(spark, sf_dir).filter(F.col("side") == "pred")
    uses = (flatten_arguments(c, ["name"], partition_by="record_id").groupBy(F.col("name").alias("tool"), F.col("base_key").alias("param"))
            .agg(F.count(F.lit(1)).alias("n_pred_uses")))
    return (params.filter(F.col("param") != "title").select("tool", "param")
            .join(uses, ["tool", "param"], "left")
            .select("tool", "param", F.coalesce("n_pred_uses", F.lit(0)).alias("n_pred_uses")))


@register("flatten_params", oracle=_BASE + _FLAT.format(keep="r.record_id, r.side, r.ordinal, r.name", src="rows"))
def flatten_params(spark, sf_dir):
    return flatten_arguments(calls(spark, sf_dir), ["record_id", "side", "ordinal", "name"], partition_by="record_id")


@register("values_match", oracle=_BASE + """
, fl AS (""" + _FLAT.format(keep="r.record_id, r.side, r.ordinal", src="rows") + """)
, g AS (SELECT record_id, key, type_tag AS g_tag, str_val AS g_str, num_val AS g_num FROM fl WHERE side = 'gt')
, p AS (SELECT record_id, key, type_tag AS p_tag, str_val AS p_str, num_val AS p_num FROM fl WHERE side = 'pred' AND ordinal = 0)
SELECT record_id, key, """ + _MATCH.format(g="g", p="p") + """ AS is_match FROM g JOIN p USING (record_id, key)""")
def values_match_plan(spark, sf_dir):
    fl = flatten_arguments(calls(spark, sf_dir), ["record_id", "side", "ordinal"], partition_by="record_id")
    g = fl.filter(F.col("side") == "gt").select("record_id", "key", F.col("type_tag").alias("g_tag"),
                                                F.col("str_val").alias("g_str"), F.col("num_val").alias("g_num"))
    p = fl.filter((F.col("side") == "pred") & (F.col("ordinal") == 0)).select(
        "record_id", "key", F.col("type_tag").alias("p_tag"), F.col("str_val").alias("p_str"), F.col("num_val").alias("p_num"))
    m = values_match(F.col("g_tag"), F.col("g_str"), F.col("g_num"), F.col("p_tag"), F.col("p_str"), F.col("p_num"))
    return g.join(p, ["record_id", "key"]).select("record_id", "key", m.alias("is_match"))


@register("when2call", oracle=_BASE + _W2C + "SELECT * FROM w2c")
def when2call(spark, sf_dir):
    return T.when2call(items(spark, sf_dir))


def _only_tool(spark, sf_dir, metrics):
    """Single-metric plans read the one-pass table; column pruning keeps only
    the requested metric expressions."""
    tools, params = fixture_catalog(spark)
    wide = T.tool_scores_wide(items(spark, sf_dir), calls(spark, sf_dir), tools, params, metrics)
    both = (F.col("gt_type") == "tool") & (F.col("pred_type") == "tool")
    return wide.filter(both).select("record_id", *[f"score_{m}" for m in metrics])


@register("tool_pickup", oracle=_BASE + _PICKUP + "SELECT * FROM pickup")
def tool_pickup(spark, sf_dir):
    return _only_tool(spark, sf_dir, ["tool_pick_up_rate", "tool_hallucination_rate", "tool_additional_rate"])


@register("variable_metrics", oracle=_BASE + _VARIABLE + "SELECT * FROM variable")
def variable_metrics(spark, sf_dir):
    return _only_tool(spark, sf_dir, ["variable_pickup_rate", "variable_correct_rate",
                                      "variable_hallucination_rate", "variable_additional_rate"])


@register("exact_match", oracle=_BASE + _EXACT + "SELECT * FROM exact")
def exact_match(spark, sf_dir):
    return _only_tool(spark, sf_dir, ["exact_match"])


@register("tool_scores_wide", oracle=_BASE + _W2C + _PICKUP + _VARIABLE + _EXACT + """
SELECT i.record_id, i.gt_type, i.pred_type, score_when2call, score_schema_reliability_raw, score_schema_reliability_processed,
       score_tool_pick_up_rate, score_tool_hallucination_rate, score_tool_additional_rate,
       score_variable_pickup_rate, score_variable_correct_rate, score_variable_hallucination_rate,
       score_variable_additional_rate, score_exact_match
FROM items i JOIN w2c USING (record_id) JOIN sr USING (record_id) LEFT JOIN pickup USING (record_id)
LEFT JOIN variable USING (record_id) LEFT JOIN exact USING (record_id)""")
def tool_scores_wide(spark, sf_dir):
    tools, params = fixture_catalog(spark)
    return T.tool_scores_wide(items(spark, sf_dir), calls(spark, sf_dir), tools, params)


@register("bucket_counts", oracle=_BASE + "SELECT gt_type, count(*) AS n_records FROM items GROUP BY 1")
def bucket_counts(spark, sf_dir):
    return T.bucket_counts(items(spark, sf_dir))
