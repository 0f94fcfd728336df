"""Plans over raw model outputs (fixture F-G) and native calls (F-B):
O-26, O-28, O-34..O-46, O-59/O-60."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorecraft.operators import parsing as P
from scorecraft.operators import tool_metrics as T
from scorecraft.plans.fixtures import fixture, fixture_sql
from scorecraft.plans.registry import register


def text_responses(spark, sf_dir):
    g = fixture(spark, sf_dir, "raw_outputs")
    return g.select("record_id", "content", F.lit(None).cast(P.NATIVE_CALLS_TYPE).alias("tool_calls"), "error")


def native_responses(spark, sf_dir):
    b = fixture(spark, sf_dir, "tool_calls")
    call = F.struct(F.lit("function").alias("type"),
                    F.struct(F.col("pred_tool").alias("name"), F.col("pred_args").alias("arguments")).alias("function"))
    return b.select("record_id",
                    F.when(F.col("pred_type") == "nlp", F.lit("a text answer")).alias("content"),
                    F.when(F.col("pred_type") == "tool", F.array(call)).alias("tool_calls"),
                    F.when(F.col("pred_type") == "error", F.lit("timeout")).alias("error"))


def _summary(parsed):
    t = F.col("pred_tools")
    return parsed.select("record_id", "pred_type",
                         F.when(t.isNotNull(), F.size(t)).alias("n_tools"),
                         t[0]["name"].alias("first_tool"), "pred_response", "parse_strategy")


_G = "WITH g AS (" + fixture_sql("raw_outputs") + """)
, e AS (SELECT record_id, record_id % 9 AS r, content FROM g)
, x AS (SELECT record_id, r, content,
          CASE WHEN r = 8 THEN 'error' WHEN r IN (3, 5, 7) THEN 'nlp' ELSE 'tool' END AS pred_type,
          CASE WHEN r = 8 THEN 'error' WHEN r IN (0, 5) THEN 'json_tolerant' WHEN r = 1 THEN 'json_fenced'
               WHEN r IN (2, 6) THEN 'json_strict' WHEN r = 4 THEN 'json_substring' WHEN r = 3 THEN 'text_fallback'
               ELSE 'plain_text' END AS parse_strategy,
          CASE WHEN r IN (0, 1, 4, 6) THEN 'show_pie_chart' WHEN r = 2 THEN 'show_line_chart' END AS first_tool,
          CASE WHEN r = 3 THEN content WHEN r = 5 THEN 'hello' WHEN r = 7 THEN content END AS pred_response
        FROM e)
"""


@register("parse_outputs_types", oracle=_G + """
SELECT record_id, pred_type, CASE WHEN pred_type = 'tool' THEN 1 END AS n_tools, first_tool, pred_response, parse_strategy FROM x""")
def parse_outputs_types(spark, sf_dir):
    return _summary(P.parse_outputs(text_responses(spark, sf_dir), "json"))


@register("parse_json_strategies", oracle=_G + "SELECT record_id, parse_strategy, pred_type FROM x")
def parse_json_strategies(spark, sf_dir):
    return P.parse_outputs(text_responses(spark, sf_dir), "json").select("record_id", "parse_strategy", "pred_type")


@register("parse_pythonic_calls", oracle=_G + """
SELECT record_id, CASE WHEN r = 3 THEN 'tool' ELSE pred_type END AS pred_type,
       CASE WHEN r = 3 THEN 'show_pie_chart' ELSE first_tool END AS first_tool,
       CASE WHEN r IN (0, 1, 3, 4, 6) THEN '5' END AS limit_arg,
       CASE WHEN r = 3 THEN 'spending' END AS data_type_arg,
       CASE WHEN r = 3 THEN 'pythonic' ELSE parse_strategy END AS parse_strategy
FROM x""")
def parse_pythonic_calls(spark, sf_dir):
    p = P.parse_outputs(text_responses(spark, sf_dir), "pythonic")
    args = F.col("pred_tools")[0]["arguments"]
    return p.select("record_id", "pred_type", F.col("pred_tools")[0]["name"].alias("first_tool"),
                    F.get_json_object(args, "$.limit").alias("limit_arg"),
                    F.get_json_object(args, "$.data_source.data_type").alias("data_type_arg"), "parse_strategy")


_B = "WITH b AS (" + fixture_sql("tool_calls") + ")\n"


@register("parse_native_calls", oracle=_B + """
SELECT record_id, pred_type, CASE WHEN pred_type = 'tool' THEN 1 END AS n_tools,
       CASE WHEN pred_type = 'tool' THEN pred_tool END AS first_tool,
       CASE WHEN pred_type = 'nlp' THEN 'a text answer' END AS pred_response,
       CASE pred_type WHEN 'tool' THEN 'native' WHEN 'nlp' THEN 'plain_text' ELSE 'error' END AS parse_strategy
FROM b""")
def parse_native_calls(spark, sf_dir):
    return _summary(P.parse_outputs(native_responses(spark, sf_dir), "json"))


@register("parse_postprocessed", oracle=_B + """
SELECT record_id, CASE WHEN pred_type = 'tool' THEN 'tool' ELSE 'nlp' END AS pred_type, CASE WHEN pred_type = 'tool' THEN 1 END AS n_tools,
       CASE WHEN pred_type = 'tool' THEN pred_tool END AS first_tool,
       CASE pred_type WHEN 'nlp' THEN 'a text answer' WHEN 'error' THEN '' END AS pred_response,
       CAST(NULL AS VARCHAR) AS raw_text
FROM b""")
def parse_postprocessed(spark, sf_dir):
    r = native_responses(spark, sf_dir)
    flat = r.select("record_id", "content", F.transform("tool_calls", lambda c: F.struct(
        c["function"]["name"].alias("name"), c["function"]["arguments"].alias("arguments"))).alias("tool_calls"))
    p = P.parse_postprocessed(flat)
    t = F.col("pred_tools")
    return p.select("record_id", "pred_type", F.when(t.isNotNull(), F.size(t)).alias("n_tools"),
                    t[0]["name"].alias("first_tool"), "pred_response", "raw_text")


@register("parse_report", oracle=_G + """
, bp AS (SELECT 'json' AS parser, parse_strategy, pred_type FROM x
           UNION ALL SELECT 'pythonic', CASE WHEN r = 3 THEN 'pythonic' ELSE parse_strategy END,
                            CASE WHEN r = 3 THEN 'tool' ELSE pred_type END FROM x)
SELECT parser, parse_strategy, pred_type, count(*) AS n,
       avg(CASE WHEN pred_type = 'error' THEN 1.0 ELSE 0.0 END) AS error_share
FROM bp GROUP BY 1, 2, 3""")
def parse_report(spark, sf_dir):
    r = text_responses(spark, sf_dir)
    both = (P.parse_outputs(r, "json").withColumn("parser", F.lit("json"))
            .unionByName(P.parse_outputs(r, "pythonic").withColumn("parser", F.lit("pythonic"))))
    return P.parse_report(both, ["parser"])


@register("schema_reliability", oracle=_G + """
SELECT record_id,
       CAST(CASE WHEN r IN (0, 2, 5, 6, 8) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score_schema_reliability_raw,
       CAST(CASE WHEN pred_type = 'tool' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score_schema_reliability_processed
FROM x""")
def schema_reliability(spark, sf_dir):
    parsed = P.parse_outputs(text_responses(spark, sf_dir), "json")
    items = parsed.select("record_id", F.lit("tool").alias("gt_type"), "pred_type", "raw_text", "raw_ok")
    return T.schema_reliability(items)


@register("responses_ingest", oracle=_B.replace("WITH", "WITH g AS (" + fixture_sql("raw_outputs") + "),") + """
SELECT b.record_id,
       CASE WHEN g.error IS NOT NULL THEN 'empty' WHEN b.pred_type = 'tool' THEN 'tool' ELSE 'content' END AS output_kind,
       CASE WHEN g.error IS NULL AND b.pred_type <> 'tool' THEN coalesce(g.content, '') END AS content
FROM b JOIN g USING (record_id)""")
def responses_ingest(spark, sf_dir):
    """O-26: response lines meet their requests by key; a request without a
    line (here: the timed-out ones) becomes an empty output."""
    records = fixture(spark, sf_dir, "tool_calls").select("record_id")
    g = fixture(spark, sf_dir, "raw_outputs")
    b = native_responses(spark, sf_dir).select("record_id", "tool_calls")
    lines = g.filter(F.col("error").isNull()).join(b, "record_id").select("record_id", "content", "tool_calls")
    return P.ingest_responses(records, lines).drop("tool_calls", "error")


@register("response_lines_parsed", oracle=_B + """
SELECT cast(record_id AS VARCHAR) AS record_id, pred_type, CASE WHEN pred_type = 'tool' THEN 1 END AS n_tools,
       CASE WHEN pred_type = 'tool' THEN pred_tool END AS first_tool,
       CASE WHEN pred_type = 'nlp' THEN concat('answer ', cast(record_id AS VARCHAR)) END AS pred_response,
       CASE pred_type WHEN 'tool' THEN 'native' WHEN 'nlp' THEN 'plain_text' ELSE 'empty' END AS parse_strategy
FROM b""")
def response_lines_parsed(spark, sf_dir):
    """O-23, O-26, O-34: batch answer lines, some of them outdated, meet their
    requests and are parsed; a request without a line is an empty answer."""
    b = fixture(spark, sf_dir, "tool_calls").withColumn("record_id", F.col("record_id").cast("string"))
    call = F.struct(F.lit("function").alias("type"),
                    F.struct(F.col("pred_tool").alias("name"), F.col("pred_args").alias("arguments")).alias("function"))

    def line(message):
        body = F.struct(F.array(F.struct(message.alias("message"))).alias("choices"))
        return F.to_json(F.struct(F.col("record_id").alias("custom_id"), F.struct(body.alias("body")).alias("response"))).alias("line")

    text = F.struct(F.when(F.col("pred_type") == "nlp", F.concat(F.lit("answer "), F.col("record_id"))).alias("content"),
                    F.when(F.col("pred_type") == "tool", F.array(call)).alias("tool_calls"))
    answered = b.filter(F.col("pred_type") != "error")
    stale = answered.filter(F.col("record_id").cast("long") % 10 == 0)
    lines = (answered.select(line(text), F.lit(2).alias("line_no"))
             .unionByName(stale.select(line(F.struct(F.lit("outdated").alias("content"))), F.lit(1).alias("line_no"))))
    outputs = P.ingest_responses(b.select("record_id"), P.response_lines(lines))
    return _summary(P.parse_outputs(outputs, "json"))


@register("response_error_rate", oracle="WITH g AS (" + fixture_sql("raw_outputs") + """)
SELECT count(*) AS n, count(error) AS n_error, avg(CASE WHEN error IS NOT NULL THEN 1.0 ELSE 0.0 END) AS error_rate FROM g""")
def response_error_rate(spark, sf_dir):
    g = fixture(spark, sf_dir, "raw_outputs")
    return g.agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("n_error"),
                 F.avg(F.col("error").isNotNull().cast("double")).alias("error_rate"))


@register("responses_normalise_structured", oracle=_G + """
SELECT record_id,
       CASE WHEN r = 8 THEN NULL WHEN r = 0 THEN NULL WHEN r = 5 THEN 'hello' ELSE coalesce(content, '') END AS content,
       CASE WHEN r = 0 THEN 'show_pie_chart' END AS tool_name,
       CASE WHEN r = 0 THEN '5' END AS limit_arg
FROM x""")
def responses_normalise_structured(spark, sf_dir):
    """O-27: label-task answers in JSON are unwrapped into a call or text."""
    from scorecraft.operators.exchange import normalise_outputs
    n = normalise_outputs(text_responses(spark, sf_dir), structured_labels=True, layout="online")
    first = F.col("tool_calls")[0]["function"]
    return n.select("record_id", "content", first["name"].alias("tool_name"),
                    F.get_json_object(first["arguments"], "$.limit").alias("limit_arg"))


@register("alignment_report", oracle="WITH b AS (" + fixture_sql("tool_calls") + "), g AS (" + fixture_sql("raw_outputs") + """)
SELECT count(*) AS n_records, count(g.record_id) AS n_outputs, count(g.record_id) AS n_matched,
       count(*) - count(g.record_id) AS n_records_without_output, CAST(0 AS BIGINT) AS n_outputs_without_record
FROM b LEFT JOIN (SELECT record_id FROM g WHERE error IS NULL) g USING (record_id)""")
def alignment_report(spark, sf_dir):
    """O-47: matched / unmatched counts of records and response lines."""
    records = fixture(spark, sf_dir, "tool_calls").select("record_id")
    lines = fixture(spark, sf_dir, "raw_outputs").filter(F.col("error").isNull()).select("record_id")
    return T.alignment_report(records, lines)


@register("answer_lines_quarantine", oracle="WITH l AS (" + fixture_sql("answer_lines") + """)
, q AS (SELECT conv_id * 100000 + turn * 2 + 1 AS no, (conv_id + turn) % 7 AS kind, concat(cast(conv_id AS VARCHAR), ':', cast(turn AS VARCHAR)) AS id, text
        FROM conversations WHERE role = 'assistant')
, x AS (SELECT no AS line_no, id, text, kind, false AS early FROM q UNION ALL SELECT no - 1, id, concat('draft ', text), kind, true FROM q WHERE kind = 2)
SELECT x.line_no, CASE WHEN kind IN (0, 3) THEN NULL WHEN kind = 1 THEN concat('x', id) ELSE id END AS custom_id,
       CASE WHEN kind = 0 THEN 'unreadable' WHEN kind = 1 THEN 'orphan' WHEN kind = 3 THEN 'no_id' WHEN early THEN 'outdated' ELSE 'good' END AS status,
       CASE WHEN kind <> 0 THEN x.text END AS content, CASE WHEN kind = 0 THEN l.line END AS text
FROM x JOIN l USING (line_no)""")
def answer_lines_quarantine(spark, sf_dir):
    """O-26, O-28: what becomes of every batch answer line; the contents are table text."""
    found = P.answer_lines(fixture(spark, sf_dir, "answer_lines"), fixture(spark, sf_dir, "answer_requests"))
    return found.select("line_no", "custom_id", "status", "content", "text")


@register("answers_by_request", oracle="""
SELECT concat(cast(conv_id AS VARCHAR), ':', cast(turn AS VARCHAR)) AS record_id,
       CASE WHEN (conv_id + turn) % 7 IN (0, 1, 3) THEN 'empty' ELSE 'content' END AS output_kind,
       CASE WHEN (conv_id + turn) % 7 NOT IN (0, 1, 3) THEN text END AS content
FROM conversations WHERE role = 'assistant'""")
def answers_by_request(spark, sf_dir):
    """O-26, O-27: each request with the answer of its one good line; no request is lost or doubled."""
    requests = fixture(spark, sf_dir, "answer_requests")
    good = P.good_answers(P.answer_lines(fixture(spark, sf_dir, "answer_lines"), requests))
    return P.ingest_responses(requests.select("record_id"), good).select("record_id", "output_kind", "content")
