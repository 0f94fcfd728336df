"""Evaluation-shaped inputs derived from the driver tables.

Each fixture is one SQL text valid in Spark SQL and DuckDB.  Table references
are ``{name}`` placeholders: Spark binds DataFrames through ``spark.sql``
keyword arguments, the DuckDB oracle substitutes the view names.  Choices are
deterministic arithmetic on keys, so both engines see the same rows, and every
fixture spans its whole source table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from scorecraft.sources.tables import table

# F-A: chat turns.  Categories and tool turns from key arithmetic; assistant
# turns right before a tool turn carry a native call (JSON text).  Every
# conversation is kept whole; in addition its opening message alone forms a
# one-message sample (key -conv_id - 1), which the pre-processing must
# quarantine as too short.
TURNS = """
select case conv_id % 3 when 0 then 'complete' when 1 then 'incomplete' else 'nlp' end as category,
       conv_id,
       concat('u', cast(conv_id as string)) as uid,
       turn as turn_idx,
       case when role = 'assistant' and (conv_id + turn) % 5 = 0 then 'tool' else role end as role,
       text as content,
       case when role = 'assistant' and (conv_id + turn) % 5 = 4
            then concat('{"name": "show_pie_chart", "arguments": {"limit": ', cast(turn as string), '}}')
       end as tool_calls
from {conversations}
union all
select case conv_id % 3 when 0 then 'complete' when 1 then 'incomplete' else 'nlp' end as category,
       -conv_id - 1 as conv_id,
       concat('s', cast(conv_id as string)) as uid,
       turn as turn_idx, role, text as content, cast(null as string) as tool_calls
from {conversations}
where turn = 0
"""

# F-B: ground-truth and predicted tool calls (JSON argument text).
TOOL_CALLS = """
select o_orderkey as record_id,
       case o_orderkey % 3 when 0 then 'show_pie_chart' when 1 then 'show_stacked_bar_chart' else 'show_line_chart' end as gt_tool,
       concat('{"data_source":{"data_type":"', case when o_orderkey % 2 = 0 then 'spending' else 'income' end,
              '","limit":', cast(o_orderkey % 10 as string), '},"payees":["a","b"],"title":"t"}') as gt_args,
       case when o_orderkey % 13 = 0 then 'nlp' when o_orderkey % 19 = 0 then 'error' else 'tool' end as pred_type,
       case when o_orderkey % 7 = 0 then 'show_line_chart' when o_orderkey % 11 = 0 then 'draw_map'
            else case o_orderkey % 3 when 0 then 'show_pie_chart' when 1 then 'show_stacked_bar_chart' else 'show_line_chart' end end as pred_tool,
       concat('{"data_source":{"data_type":"', case when o_orderkey % 5 = 0 then 'SPENDING' else 'spending' end, '"',
              case when o_orderkey % 17 = 0 then '' else concat(',"limit":', cast(o_orderkey % 10 as string), '.0') end,
              '},"payees":', case when o_orderkey % 4 = 0 then '["b","a"]' else '["a","b"]' end,
              case when o_orderkey % 6 = 0 then ',"colour":"red"' else '' end, ',"title":"other"}') as pred_args
from {orders}
"""

# F-B long form: one row per call and side.  Orders with o_orderkey % 8 = 0
# get a second predicted call (a duplicate name for half of them) so that
# multi-call records and duplicate names are exercised.
TOOL_CALL_ROWS = """
with fb as (""" + TOOL_CALLS + """)
select record_id, 'gt' as side, 0 as ordinal, gt_tool as name, gt_args as arguments from fb
union all
select record_id, 'pred' as side, 0 as ordinal, pred_tool as name, pred_args as arguments from fb where pred_type = 'tool'
union all
select record_id, 'pred' as side, 1 as ordinal,
       case when record_id % 16 = 0 then pred_tool else 'show_pie_chart' end as name,
       '{"limit":3,"title":"x"}' as arguments
from fb where pred_type = 'tool' and record_id % 8 = 0
"""

# F-C: guardrail rows (labels joined to documents) with raw model output.
GUARDRAIL = """
select l.doc_id as sample_id, d.text as prompt,
       case when l.toxic = 1 then 'unsafe' else 'safe' end as prompt_label,
       case when l.quality = 1 then 'S1' else '' end as violated_categories,
       case when l.doc_id % 23 = 0 then 'cannot say' when l.doc_id % 7 = 0 then ' Unsafe '
            when l.doc_id % 5 = 0 then 'unsafe' when l.toxic = 1 and l.doc_id % 3 <> 0 then 'unsafe' else 'safe' end as output
from {labels} l join {documents} d on l.doc_id = d.doc_id
"""

# F-D: reference / prediction text pairs from assistant turns, whole texts.  The
# tables hold no digits, so an edit that writes a 7 has a known distance.
TEXT_PAIRS = """
select conv_id, turn, text as reference_text,
       case (conv_id + turn) % 5 when 0 then replace(text, 'e', '7') when 1 then concat(text, ' 777') when 2 then text
            when 3 then concat('7 ', replace(text, 'n', '7')) else '' end as prediction_text
from {conversations} where role = 'assistant'
"""

# F-E: per-item scores of several runs and models (m0 appears in two runs).
RUN_SCORES = """
select run_ts, model, o_orderkey as record_id,
       case when o_orderkey % k = 0 then null else cast(o_orderkey % 2 as double) end as score_exact_match,
       case when o_orderkey % 13 = 0 then null else cast((o_orderkey % (k + 3)) / 10.0 as double) end as score_variable_correct_rate,
       case when o_orderkey % 11 = 0 then null else cast((o_orderkey % (k + 5)) / 20.0 as double) end as score_tool_hallucination_rate,
       case when o_orderkey % 17 = 0 then null else cast(1 + (o_orderkey + k) % 5 as double) end as score_content_similarity,
       cast((o_orderkey % (k + 7)) as double) as score_levenshtein_distance
from (
  select '2026-01-01_00-00-00' as run_ts, 'm0' as model, 3 as k, o_orderkey from {orders}
  union all select '2026-01-02_00-00-00' as run_ts, 'm0' as model, 4 as k, o_orderkey from {orders}
  union all select '2026-01-01_00-00-00' as run_ts, 'm1' as model, 5 as k, o_orderkey from {orders}
) m
"""

# F-F: token vectors for the greedy embedding match.
TOKEN_VECS = """
select cast(floor(vec_id / 10.0) as bigint) as record_id,
       case when vec_id % 2 = 0 then 'ref' else 'pred' end as side, vec_id % 10 as pos, embedding as vec
from {embeddings}
"""

# F-G: raw model outputs of every shape the parser must handle.
RAW_OUTPUTS = """
select o_orderkey as record_id,
       case when o_orderkey % 9 = 8 then 'timeout' end as error,
       case o_orderkey % 9
         when 0 then '{"tool_calls":{"name":"show_pie_chart","args":{"limit":5}}}'
         when 1 then concat(repeat('`', 3), 'json', chr(10), '{"name":"show_pie_chart","parameters":{"limit":5}}', chr(10), repeat('`', 3))
         when 2 then '[{"show_line_chart":{"metric":"balance"}}]'
         when 3 then '[show_pie_chart(limit=5, data_source={data_type=spending})]'
         when 4 then 'Sure: {"name":"show_pie_chart","parameters":{"limit":5}} done'
         when 5 then '{"content":"hello"}'
         when 6 then '{"name":"show_pie_chart","arguments":{"limit":5}}'
         when 7 then concat('plain answer ', cast(o_orderkey as string)) end as content
from {orders}
"""

# F-H: judge outputs per (record, metric).
JUDGE_OUTPUTS = """
select event_id as record_id,
       case event_id % 2 when 0 then 'content_similarity' else 'content_politeness' end as metric,
       case event_id % 2 when 0 then 'score_1_5' else 'binary' end as output_type,
       case event_id % 9 when 0 then '4' when 1 then ' 1 ' when 2 then '9' when 3 then '0.5' when 4 then 'yes'
            when 5 then '' when 6 then 'nan' when 7 then concat(chr(9), '2', chr(10)) else '0' end as output
from {events}
"""

# Arguments in the nested layout that the simplified schema flattens (O-13).
FILTER_ARGS = """
select o_orderkey as record_id,
       concat('{"data_source":{"source":"transactions","data_type":"',
              case when o_orderkey % 2 = 0 then 'spending' else 'income' end, '"',
              case when o_orderkey % 3 = 0 then ',"filter":{"categories":["food","rent"],"payees":["shop"],"min_amount":5}' else '' end,
              '},',
              case when o_orderkey % 3 <> 0 and o_orderkey % 5 = 0 then '"filter":{"payees":["bank"],"max_amount":9},' else '' end,
              '"limit":', cast(o_orderkey % 10 as string), '}') as arguments
from {orders}
"""

# Calls of two freight tools (O-97), values drawn from the order row.
FREIGHT_CALLS = """
select o_orderkey as record_id, 0 as ordinal,
       case when o_orderkey % 3 = 0 then 'quote_freight' else 'book_freight' end as name,
       concat('{"mode":"', case o_orderkey % 4 when 0 then 'sea' when 1 then 'air' when 2 then 'sea' else 'road' end,
              '","class":"', o_orderpriority, '","ports":["', case o_orderkey % 5 when 0 then 'kobe' when 1 then 'oslo'
              when 2 then 'lima' else 'cork' end, '","oslo"],"box":"b', cast(o_custkey % 3 as string), '"}') as arguments
from {orders}
"""

# Legacy one-turn layout (O-08): each user turn with its assistant answer.
LEGACY_PAIRS = """
select c.conv_id, c.turn as user_turn, c.text as query, n.text as answer,
       case when (c.conv_id + n.turn) % 5 = 0 then 'tool' else 'nlp' end as gt_type, n.turn as answer_turn
from {conversations} c join {conversations} n on n.conv_id = c.conv_id and n.turn = c.turn + 1
where c.role = 'user' and n.role = 'assistant'
"""

# Batch answer lines (O-26): each assistant turn answers the request ``conv_id:turn`` with its
# text.  Some lines are cut off, some name an unknown request or none, and some requests are
# answered twice, the later line being the turn's text.
_JSON_TEXT = "replace(replace(replace(replace(text, chr(92), concat(chr(92), chr(92))), chr(34), concat(chr(92), chr(34))), chr(10), concat(chr(92), 'n')), chr(9), concat(chr(92), 't'))"
ANSWER_LINES = """
with a as (select conv_id, turn, (conv_id + turn) % 7 as kind, concat(cast(conv_id as string), ':', cast(turn as string)) as id,
                  concat('"response":{"status_code":200,"body":{"choices":[{"message":{"role":"assistant","content":"', """ + _JSON_TEXT + """, '"}}]}}}') as body
           from {conversations} where role = 'assistant')
select conv_id * 100000 + turn * 2 + 1 as line_no,
       case kind when 0 then concat('{"custom_id":"', id, '",', substr(body, 1, length(body) - 9))
                 when 1 then concat('{"custom_id":"x', id, '",', body)
                 when 3 then concat('{', body)
                 else concat('{"custom_id":"', id, '",', body) end as line
from a
union all
select conv_id * 100000 + turn * 2 as line_no, concat('{"custom_id":"', id, '",', replace(body, '"content":"', '"content":"draft ')) as line
from a where kind = 2
"""

# The requests that those lines answer.
ANSWER_REQUESTS = """
select concat(cast(conv_id as string), ':', cast(turn as string)) as record_id, conv_id, turn, text
from {conversations} where role = 'assistant'
"""

# Judge answer lines (O-31): per assistant turn and metric a number taken from the turn's text.
JUDGE_LINES = """
with a as (select concat(cast(conv_id as string), ':', cast(turn as string), '|', metric) as id, conv_id, turn, m, (conv_id + turn + m) % 7 as kind,
                  cast(length(text) % 8 as string) as number
           from {conversations} cross join (select 'content_similarity' as metric, 0 as m union all select 'content_politeness' as metric, 1 as m) x
           where role = 'assistant')
select conv_id * 100000 + turn * 4 + m * 2 + 1 as line_no,
       concat(case kind when 0 then '' else '{' end, '"custom_id":"', case kind when 1 then 'x' else '' end, id,
              '","response":{"body":{"choices":[{"message":{"content":" ', number, ' "}}]}}}') as line
from a
union all
select conv_id * 100000 + turn * 4 + m * 2 as line_no,
       concat('{"custom_id":"', id, '","response":{"body":{"choices":[{"message":{"content":"5"}}]}}}') as line
from a where kind = 2
"""

FIXTURES = {
    "judge_lines": JUDGE_LINES,
    "answer_lines": ANSWER_LINES,
    "answer_requests": ANSWER_REQUESTS,
    "filter_args": FILTER_ARGS,
    "legacy_pairs": LEGACY_PAIRS,
    "freight_calls": FREIGHT_CALLS,
    "turns": TURNS,
    "tool_calls": TOOL_CALLS,
    "tool_call_rows": TOOL_CALL_ROWS,
    "guardrail": GUARDRAIL,
    "text_pairs": TEXT_PAIRS,
    "run_scores": RUN_SCORES,
    "token_vecs": TOKEN_VECS,
    "raw_outputs": RAW_OUTPUTS,
    "judge_outputs": JUDGE_OUTPUTS,
}

_REF = re.compile(r"\{([a-z_]+)\}")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture as a Spark DataFrame over the parquet tables in ``sf_dir``."""
    text = FIXTURES[name]
    refs = {t: table(spark, sf_dir, t) for t in set(_REF.findall(text))}
    # spark.sql formats its text like str.format: double literal braces
    # (JSON inside string constants), keep the table placeholders.
    escaped = text.replace("{", "{{").replace("}", "}}")
    escaped = re.sub(r"\{\{([a-z_]+)\}\}", lambda m: "{" + m.group(1) + "}"
                     if m.group(1) in refs else m.group(0), escaped)
    return spark.sql(escaped, **refs)


def fixture_sql(name: str) -> str:
    """The fixture as plain SQL over views named like the tables (DuckDB)."""
    return _REF.sub(lambda m: m.group(1), FIXTURES[name])


def with_fixtures(body: str, **names: str) -> str:
    """``WITH alias AS (fixture) ... body`` for oracle SQL."""
    ctes = ",\n".join(f"{alias} AS ({fixture_sql(fx)})" for alias, fx in names.items())
    return f"WITH {ctes}\n{body}"
