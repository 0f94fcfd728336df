"""Plans over request/response tables: O-23, O-30..O-33 (fixtures F-A, F-D, F-H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorecraft.operators import exchange as X
from scorecraft.operators import records as R
from scorecraft.plans.fixtures import fixture, fixture_sql
from scorecraft.plans.records_plans import SYSTEM_SECTIONS, _w, turns
from scorecraft.plans.registry import register
from scorecraft.sources.tables import table

ENABLED = ["content_similarity", "content_politeness", "content_helpfulness", "unknown_metric"]
PIVOT = ["content_similarity", "content_politeness", "context_accuracy"]


def _sql_template(template: str) -> str:
    """The same single-pass formatting in DuckDB SQL."""
    out, pos = [], 0
    for m in X._PLACEHOLDER.finditer(template):
        out.append("'" + template[pos:m.start()].replace("'", "''") + "'")
        col = {"reference": "reference_text", "prediction": "prediction_text", "query": "query"}[m.group(1)]
        out.append(f"coalesce({col}, '')")
        pos = m.end()
    out.append("'" + template[pos:].replace("'", "''") + "'")
    return "concat(" + ", ".join(out) + ")"


# Prompt texts of this fixture: placeholders between plain words.
PROMPTS = [X.JudgePrompt(m, kind, f"judge {m}", f"{m}: A={{reference}} B={{prediction}} Q={{query}} ({kind})")
           for m, kind in X.JUDGE_OUTPUT_TYPES.items()]
_JUDGE_PROMPTS = {p.metric_name: p for p in PROMPTS}


def judge_items(spark, sf_dir):
    fd = fixture(spark, sf_dir, "text_pairs")
    conv = table(spark, sf_dir, "conversations")
    prev_user = conv.filter(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("query"))
    return fd.join(prev_user, ["conv_id", "turn"], "left").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("record_id"),
        "reference_text", "prediction_text", "query")


_ITEMS_SQL = "WITH fd AS (" + fixture_sql("text_pairs") + """)
, it AS (SELECT concat_ws(':', cast(fd.conv_id AS VARCHAR), cast(fd.turn AS VARCHAR)) AS record_id,
                reference_text, prediction_text, c.text AS query
         FROM fd LEFT JOIN conversations c ON c.conv_id = fd.conv_id AND c.turn + 1 = fd.turn AND c.role = 'user')
"""


@register("judge_requests", oracle=_ITEMS_SQL + "\nUNION ALL\n".join(
    f"""SELECT record_id, '{m}' AS metric, concat(record_id, '|', '{m}') AS custom_id,
       '{_JUDGE_PROMPTS[m].system_prompt}' AS system_prompt, {_sql_template(_JUDGE_PROMPTS[m].user_prompt)} AS user_prompt,
       true AS request_ok FROM it"""
    for m in ENABLED if m in _JUDGE_PROMPTS))
def judge_requests(spark, sf_dir):
    r = X.judge_requests(judge_items(spark, sf_dir), ENABLED, PROMPTS)
    ok = F.get_json_object("request", "$.body.messages[1].content") == F.col("user_prompt")
    return r.select("record_id", "metric", "custom_id", "system_prompt", "user_prompt", ok.alias("request_ok"))


_H = "WITH h AS (" + fixture_sql("judge_outputs") + """)
, s AS (SELECT record_id, metric, output_type,
          try_cast(regexp_replace(output, '^\\s+|\\s+$', '', 'g') AS DOUBLE) AS v FROM h)
, sc AS (SELECT record_id, metric, output_type,
          CASE WHEN output_type = 'binary' THEN CASE WHEN v IS NULL OR isnan(v) THEN 0.0 WHEN v > 0.5 THEN 1.0 ELSE 0.0 END
               WHEN output_type = 'score_1_5' THEN CASE WHEN v IS NULL THEN 3.0 WHEN isnan(v) THEN 5.0
                                                       ELSE greatest(1.0, least(5.0, v)) END
               ELSE 0.0 END AS score FROM s)
"""


@register("judge_scores_parse", oracle=_H + "SELECT record_id, metric, output_type, score FROM sc")
def judge_scores_parse(spark, sf_dir):
    h = fixture(spark, sf_dir, "judge_outputs")
    return X.judge_scores(h.select("record_id", "metric", "output_type"), h)


@register("judge_scores_pivot", oracle=_H + "SELECT record_id, " + ", ".join(
    f"max(CASE WHEN metric = '{m}' THEN score END) AS {m}" for m in PIVOT) + " FROM sc GROUP BY record_id")
def judge_scores_pivot(spark, sf_dir):
    h = fixture(spark, sf_dir, "judge_outputs")
    return X.judge_scores_pivot(X.judge_scores(h.select("record_id", "metric", "output_type"), h), PIVOT)


@register("inference_requests", oracle=_w(f"""
SELECT record_id, record_id AS custom_id, CAST(n_context + 1 AS INTEGER) AS n_messages, 'system' AS first_role,
       '{R.system_message(SYSTEM_SECTIONS)}' AS system_content, 512 AS max_tokens, 'eval-model' AS model
FROM recs"""))
def inference_requests(spark, sf_dir):
    t = turns(spark, sf_dir)
    ctx = R.materialise_context(R.prediction_records(t), t, R.system_message(SYSTEM_SECTIONS))
    req = X.inference_requests(ctx, "eval-model", max_tokens=512)
    j = F.col("request")
    return req.select("record_id", F.get_json_object(j, "$.custom_id").alias("custom_id"),
                      F.json_array_length(F.get_json_object(j, "$.body.messages")).alias("n_messages"),
                      F.get_json_object(j, "$.body.messages[0].role").alias("first_role"),
                      F.get_json_object(j, "$.body.messages[0].content").alias("system_content"),
                      F.get_json_object(j, "$.body.max_tokens").cast("int").alias("max_tokens"),
                      F.get_json_object(j, "$.body.model").alias("model"))


@register("judge_lines_scored", oracle="""
WITH j AS (SELECT concat(cast(conv_id AS VARCHAR), ':', cast(turn AS VARCHAR)) AS record_id, metric, output_type,
                  CASE WHEN (conv_id + turn + m) % 7 IN (0, 1) THEN NULL ELSE length(text) % 8 END AS n
           FROM conversations CROSS JOIN (VALUES ('content_similarity', 'score_1_5', 0), ('content_politeness', 'binary', 1)) x(metric, output_type, m)
           WHERE role = 'assistant')
SELECT record_id, metric, output_type,
       CAST(CASE WHEN output_type = 'binary' THEN CASE WHEN coalesce(n, 0) > 0.5 THEN 1 ELSE 0 END
                 ELSE CASE WHEN n IS NULL THEN 3 ELSE greatest(1, least(5, n)) END END AS DOUBLE) AS score
FROM j""")
def judge_lines_scored(spark, sf_dir):
    """O-31, O-32: judge requests scored from a batch file whose lines may be damaged, outdated
    or unknown; the numbers come from the turns' texts."""
    asked = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(t).alias("output_type"))
                      for m, t in (("content_similarity", "score_1_5"), ("content_politeness", "binary"))])
    requests = fixture(spark, sf_dir, "answer_requests").select("record_id", F.inline(asked))
    return X.judge_scores_from_lines(requests, fixture(spark, sf_dir, "judge_lines"))
