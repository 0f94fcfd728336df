"""Plans over per-item rows (O-15, O-92, O-93, O-96): text answers made from the
chat turns, and label rows from F-C."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorecraft.operators import parsing as P
from scorecraft.operators import records as R
from scorecraft.operators import results as S
from scorecraft.operators import tool_metrics as T
from scorecraft.plans import label_plans, records_plans
from scorecraft.plans.registry import register


def answers(spark, sf_dir, records):
    """One answer per record: a native call, an error or the truth's own text."""
    call = F.struct(F.lit("function").alias("type"),
                    F.struct(F.lit("show_pie_chart").alias("name"),
                             F.concat(F.lit('{"limit":'), F.col("trigger_turn").cast("string"), F.lit("}")).alias("arguments")).alias("function"))
    kind = F.pmod(F.col("conv_id") + F.col("trigger_turn"), F.lit(7))
    return records.select(
        "record_id", F.when(kind > 1, F.concat(F.lit("answer "), F.coalesce("gt_content", F.lit("none")))).alias("content"),
        F.when(kind == 0, F.array(call)).alias("tool_calls"), F.when(kind == 1, F.lit("timeout")).alias("error"))


_ROWS = records_plans._w("""
, kinds AS (SELECT *, (((conv_id + trigger_turn) % 7) + 7) % 7 AS kind FROM recs)
, answered AS (SELECT *, CASE kind WHEN 0 THEN 'tool' WHEN 1 THEN 'error' ELSE 'nlp' END AS pred_type FROM kinds)
SELECT record_id, uid, category, concat('[', (SELECT string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FROM range(trigger_turn + 1) t(i)), ']') AS turn_indices,
       gt_turn_index, CASE WHEN gt_tool_calls IS NOT NULL THEN 'tool' ELSE 'nlp' END AS gt_type, gt_role,
       CASE WHEN gt_tool_calls IS NOT NULL THEN gt_tool_calls ELSE coalesce(gt_content, '') END AS gt_value, pred_type,
       CASE WHEN kind = 0 THEN concat('[{"name":"show_pie_chart","arguments":"{\\"limit\\":', CAST(trigger_turn AS VARCHAR), '}"}]') ELSE '[]' END AS pred_tools,
       CASE WHEN kind > 1 THEN regexp_replace(concat('answer ', coalesce(gt_content, 'none')), '^\\s+|\\s+$', '', 'g') ELSE '' END AS pred_response,
       CASE WHEN kind = 1 THEN 'timeout' ELSE '' END AS pred_error,
       CAST(CASE WHEN CASE WHEN gt_tool_calls IS NOT NULL THEN 'tool' ELSE 'nlp' END = pred_type THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score_when2call
FROM answered""")


@register("tool_item_rows", oracle=_ROWS)
def tool_item_rows(spark, sf_dir):
    records = R.prediction_records(records_plans.turns(spark, sf_dir))
    outputs = answers(spark, sf_dir, records)
    parsed = P.parse_outputs(outputs, "json")
    scores = T.when2call(records.select("record_id", "gt_type").join(parsed.select("record_id", "pred_type"), "record_id"))
    return S.tool_item_rows(records, parsed, scores)


@register("label_item_rows", oracle=label_plans._BASE + """
SELECT sample_id, prompt, prompt_label AS ground_truth_label, predicted_label, violated_categories,
       lower(prompt_label) = predicted_label AS correct, output AS raw_output FROM v""")
def label_item_rows(spark, sf_dir):
    valid = label_plans.valid(spark, sf_dir).withColumnRenamed("ground_truth_label", "prompt_label")
    return S.label_item_rows(valid)
