"""Plans over chat turns (fixture F-A): O-01, O-11..21."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorecraft.operators import records as R
from scorecraft.plans.fixtures import fixture, fixture_sql, with_fixtures
from scorecraft.plans.registry import register

SYSTEM_SECTIONS = ["You are a careful financial assistant.", "Answer briefly."]
HEAD_N = 25


def turns(spark, sf_dir):
    return R.filter_categories(fixture(spark, sf_dir, "turns"))


# Shared DuckDB CTEs: kept turns with their successor.
_SUCC = """
, sizes AS (SELECT category, conv_id, count(*) AS n_messages FROM t GROUP BY category, conv_id)
, k AS (SELECT t.* FROM t JOIN sizes s USING (category, conv_id) WHERE s.n_messages >= 2)
, j AS (SELECT k.*,
          lead(role) OVER (PARTITION BY category, conv_id ORDER BY turn_idx) AS next_role,
          lead(content) OVER (PARTITION BY category, conv_id ORDER BY turn_idx) AS next_content,
          lead(tool_calls) OVER (PARTITION BY category, conv_id ORDER BY turn_idx) AS next_tool_calls
        FROM k)
, recs AS (
  SELECT concat_ws(':', category, cast(conv_id AS VARCHAR), cast(turn_idx AS VARCHAR)) AS record_id,
         category, conv_id, uid, role AS trigger_role, turn_idx AS trigger_turn,
         CASE WHEN role = 'user' THEN turn_idx + 1 ELSE turn_idx END AS gt_turn_index,
         CASE WHEN role = 'user' THEN next_role ELSE role END AS gt_role,
         CASE WHEN role = 'user' THEN next_content ELSE content END AS gt_content,
         CASE WHEN role = 'user' THEN next_tool_calls ELSE tool_calls END AS gt_tool_calls,
         turn_idx + 1 AS n_context
  FROM j WHERE (role = 'user' AND next_role IS NOT NULL) OR role = 'tool')
"""


def _w(body: str) -> str:
    return "WITH t AS (" + fixture_sql("turns") + ")" + _SUCC + body


@register("turns_from_conversations", oracle=with_fixtures(
    "SELECT category, conv_id, uid, turn_idx, role, content, tool_calls FROM t", t="turns"))
def turns_from_conversations(spark, sf_dir):
    return turns(spark, sf_dir).select("category", "conv_id", "uid", "turn_idx", "role", "content", "tool_calls")


@register("category_head_n", oracle=with_fixtures(f"""
SELECT category, conv_id, turn_idx, role FROM t
WHERE (category, conv_id) IN (
  SELECT category, conv_id FROM (
    SELECT category, conv_id, row_number() OVER (PARTITION BY category ORDER BY conv_id) AS rn
    FROM (SELECT DISTINCT category, conv_id FROM t)) WHERE rn <= {HEAD_N})""", t="turns"))
def category_head_n(spark, sf_dir):
    return R.head_per_category(turns(spark, sf_dir), HEAD_N).select("category", "conv_id", "turn_idx", "role")


@register("short_sample_quarantine", oracle=with_fixtures("""
SELECT category, conv_id, count(*) AS n_messages FROM t GROUP BY category, conv_id HAVING count(*) < 2""", t="turns"))
def short_sample_quarantine(spark, sf_dir):
    _, short = R.split_short_samples(turns(spark, sf_dir))
    return short


@register("dangling_turn_quarantine", oracle=_w("""
SELECT category, conv_id, uid, turn_idx FROM j WHERE role = 'user' AND next_role IS NULL"""))
def dangling_turn_quarantine(spark, sf_dir):
    return R.dangling_user_turns(turns(spark, sf_dir))


@register("rewrite_turns", oracle=with_fixtures("""
SELECT category, conv_id, turn_idx,
       CASE WHEN role = 'tool' THEN 'user' ELSE role END AS role,
       CASE WHEN role = 'assistant' AND tool_calls IS NOT NULL THEN concat('<tool_call>', tool_calls, '</tool_call>')
            WHEN role = 'tool' THEN concat('<tool_response>', coalesce(content, ''), '</tool_response>')
            ELSE content END AS content
FROM t""", t="turns"))
def rewrite_turns(spark, sf_dir):
    return R.rewrite_turns(turns(spark, sf_dir)).select("category", "conv_id", "turn_idx", "role", "content")


@register("prediction_records", oracle=_w("""
SELECT record_id, category, conv_id, uid, trigger_role, trigger_turn, gt_turn_index, gt_role, gt_content,
       gt_tool_calls, CASE WHEN gt_tool_calls IS NOT NULL THEN 'tool' ELSE 'nlp' END AS gt_type, n_context
FROM recs"""))
def prediction_records(spark, sf_dir):
    return R.prediction_records(turns(spark, sf_dir))


@register("record_group_summary", oracle=_w("""
SELECT category, gt_role, count(*) AS n_records, round(avg(n_context), 6) AS mean_context_turns
FROM recs GROUP BY category, gt_role"""))
def record_group_summary(spark, sf_dir):
    """Flagship slice: records per (category, gt_role) and mean context length."""
    recs = R.prediction_records(turns(spark, sf_dir))
    return (recs.groupBy("category", "gt_role")
            .agg(F.count(F.lit(1)).alias("n_records"),
                 F.round(F.avg("n_context"), 6).alias("mean_context_turns")))


@register("contexts_with_system", oracle=_w(f"""
, rw AS (SELECT category, conv_id, turn_idx,
           CASE WHEN role = 'tool' THEN 'user' ELSE role END AS role,
           CASE WHEN role = 'assistant' AND tool_calls IS NOT NULL THEN concat('<tool_call>', tool_calls, '</tool_call>')
                WHEN role = 'tool' THEN concat('<tool_response>', coalesce(content, ''), '</tool_response>')
                ELSE content END AS content FROM t)
SELECT r.record_id, CAST(count(*) + 1 AS INTEGER) AS n_messages,
       'system' AS first_role, '{R.system_message(SYSTEM_SECTIONS)}' AS system_content,
       max(CASE WHEN rw.turn_idx = r.trigger_turn THEN rw.role END) AS last_role,
       max(CASE WHEN rw.turn_idx = r.trigger_turn THEN rw.content END) AS last_content,
       CAST(sum(length(rw.content)) AS BIGINT) AS context_chars
FROM recs r JOIN rw ON rw.category = r.category AND rw.conv_id = r.conv_id AND rw.turn_idx <= r.trigger_turn
GROUP BY r.record_id"""))
def contexts_with_system(spark, sf_dir):
    t = turns(spark, sf_dir)
    recs = R.prediction_records(t)
    ctx = R.materialise_context(recs, t, R.system_message(SYSTEM_SECTIONS))
    c = F.col("context")
    body = F.slice(c, 2, F.size(c))
    return ctx.select(
        "record_id",
        F.size(c).alias("n_messages"),
        c[0]["role"].alias("first_role"),
        c[0]["content"].alias("system_content"),
        F.element_at(c, -1)["role"].alias("last_role"),
        F.element_at(c, -1)["content"].alias("last_content"),
        F.aggregate(body, F.lit(0).cast("bigint"), lambda acc, m: acc + F.length(m["content"])).alias("context_chars"),
    )


@register("last_user_query", oracle=_w("""
, rw AS (SELECT category, conv_id, turn_idx, CASE WHEN role = 'tool' THEN 'user' ELSE role END AS role,
           CASE WHEN role = 'tool' THEN concat('<tool_response>', coalesce(content, ''), '</tool_response>') ELSE content END AS content FROM t)
, lu AS (SELECT r.record_id, max(rw.turn_idx) AS last_user_idx FROM recs r
         JOIN rw ON rw.category = r.category AND rw.conv_id = r.conv_id AND rw.turn_idx <= r.trigger_turn AND rw.role = 'user'
         GROUP BY r.record_id)
SELECT r.record_id, coalesce(rw.content, '') AS query
FROM recs r LEFT JOIN lu ON lu.record_id = r.record_id
LEFT JOIN rw ON rw.category = r.category AND rw.conv_id = r.conv_id AND rw.turn_idx = lu.last_user_idx"""))
def last_user_query(spark, sf_dir):
    t = turns(spark, sf_dir)
    return R.last_user_query(R.prediction_records(t), t)
