"""Model-output parsing as one Spark stage (O-34..O-46).

``responses``: ``record_id, content STRING, tool_calls ARRAY<STRUCT<type,
function: STRUCT<name, arguments STRING>>>, error STRING``.

Routing is native: error rows, native tool calls (arguments parsed with
Python's JSON rules), blank answers and bracket-free text are decided by column
expressions.  Only answers holding a bracket reach the Arrow UDF -- the others
are passed to it as NULL, so the input is scanned once and only the texts that
need the Python ladder cross into Python.

Output (``PARSED_COLUMNS``): ``pred_type`` (tool | nlp | error), ``pred_tools
ARRAY<STRUCT<name, arguments JSON text>>``, ``pred_response``, ``pred_error``,
``parse_strategy``, ``raw_text`` (the answer text a raw-output metric sees:
'' for native calls and errors) and ``raw_ok`` (strict JSON or pythonic call).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorecraft.functions.arguments import is_json
from scorecraft.functions.output_parser import KNOWN_TOOL_NAMES, clean_text, parse_text, tools_json
from scorecraft.functions.partitioning import by_key
from scorecraft.functions.text import py_strip
from scorecraft.functions.windows import top_n_per_group

PARSERS = ("json", "pythonic")
TOOLS_TYPE = "array<struct<name:string,arguments:string>>"
PARSED_COLUMNS = ["record_id", "pred_type", "pred_tools", "pred_response", "pred_error",
                  "parse_strategy", "raw_text", "raw_ok"]

_UDF_SCHEMA = T.StructType([
    T.StructField("pred_type", T.StringType()),
    T.StructField("tools_json", T.StringType()),
    T.StructField("pred_response", T.StringType()),
    T.StructField("pred_error", T.StringType()),
    T.StructField("parse_strategy", T.StringType()),
    T.StructField("raw_ok", T.BooleanType()),
])

# A JSON scalar (what json.loads accepts without brackets).
_JSON_SCALAR = (r'^(-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity'
                r'|"([^"\\\x00-\x1f]|\\.)*")$')

NATIVE_CALLS_TYPE = T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("function", T.StructType([T.StructField("name", T.StringType()),
                                            T.StructField("arguments", T.StringType())]))]))


def parsed_row(text: str | None, parser: str, known) -> tuple:
    """The UDF's row for one answer; any failure becomes an error row."""
    if text is None:
        return (None,) * 6
    try:
        kind, calls, response, error, strategy, ok = parse_text(text, parser, known)
        return kind, None if calls is None else tools_json(calls), clean_text(response), clean_text(error), strategy, ok
    except Exception as problem:  # noqa: BLE001 - a bad answer is an error row, never a failed job
        return "error", None, None, f"{type(problem).__name__}: unreadable answer", "exception", False


def _parse_udf(parser: str, known: tuple[str, ...]):
    @F.pandas_udf(_UDF_SCHEMA)
    def parse_batch(text: pd.Series) -> pd.DataFrame:
        out = {k: [] for k in _UDF_SCHEMA.fieldNames()}
        for t in text:
            for k, v in zip(out, parsed_row(t, parser, known)):
                out[k].append(v)
        return pd.DataFrame(out)
    return parse_batch


def parse_outputs(responses: DataFrame, parser: str = "json", known=KNOWN_TOOL_NAMES) -> DataFrame:
    """O-34/O-35/O-44: parse every response; never fails on a bad row."""
    if parser not in PARSERS:
        raise ValueError(f"unknown parser {parser!r}; choose from {PARSERS}")
    tc = F.col("tool_calls")
    has_calls = tc.isNotNull() & (F.size(tc) > 0)
    native = F.transform(tc, lambda c: F.struct(F.coalesce(c["function"]["name"], F.lit("")).alias("name"),
                                                F.coalesce(c["function"]["arguments"], F.lit("{}")).alias("arguments")))
    texts = F.to_json(F.transform(tc, lambda c: F.coalesce(c["function"]["arguments"], F.lit("{}"))))
    text = F.coalesce(F.col("content"), F.lit(""))
    stripped = py_strip(text)
    blank = stripped == ""
    # '(' also needs Python: a pythonic call makes the raw output valid.
    needs_udf = F.col("error").isNull() & ~has_calls & ~blank & text.rlike("[\\[{(]")
    # Hash on record_id first: the Python stage runs on every shuffle
    # partition, and the scoring joins downstream reuse this partitioning.
    d = by_key(responses, "record_id").withColumn("_p", _parse_udf(parser, tuple(known))(F.when(needs_udf, text)))
    d = d.withColumn("_json", is_json(F.when(has_calls, texts)))
    native_bad = ~F.coalesce(F.col("_json"), F.lit(True))
    is_err = F.col("error").isNotNull()
    kind = (F.when(is_err, "error")
            .when(has_calls, F.when(native_bad, "error").otherwise("tool"))
            .when(blank, "error")
            .when(needs_udf, F.col("_p.pred_type"))
            .otherwise("nlp"))
    tools = (F.when(~is_err & has_calls & ~native_bad, native)
             .when(needs_udf & (F.col("_p.pred_type") == "tool"), F.from_json(F.col("_p.tools_json"), TOOLS_TYPE)))
    response = (F.when(is_err | has_calls | blank, F.lit(None))
                .when(needs_udf, F.col("_p.pred_response"))
                .otherwise(stripped))
    error = (F.when(is_err, F.col("error"))
             .when(has_calls & native_bad, F.lit("invalid tool_call arguments"))
             .when(has_calls, F.lit(None))
             .when(blank, F.lit("empty output"))
             .when(needs_udf, F.col("_p.pred_error")))
    strategy = (F.when(is_err, "error").when(has_calls, "native").when(blank, "empty")
                .when(needs_udf, F.col("_p.parse_strategy")).otherwise("plain_text"))
    raw_text = F.when(is_err | has_calls, F.lit("")).otherwise(text)
    raw_ok = (F.when(is_err | has_calls | blank, F.lit(True))
              .when(needs_udf, F.col("_p.raw_ok"))
              .otherwise(stripped.rlike(_JSON_SCALAR)))
    return d.select("record_id", kind.alias("pred_type"), tools.alias("pred_tools"), response.alias("pred_response"),
                    error.alias("pred_error"), strategy.alias("parse_strategy"), raw_text.alias("raw_text"),
                    raw_ok.alias("raw_ok"))


def parse_postprocessed(outputs: DataFrame) -> DataFrame:
    """O-45: outputs that are already structured (``tool_calls`` holding
    ``{name, arguments}`` or ``content``) map directly; an empty output is an
    empty text; no raw text."""
    tc = F.col("tool_calls")
    has_calls = tc.isNotNull() & (F.size(tc) > 0)
    return outputs.select(
        "record_id",
        F.when(has_calls, "tool").otherwise("nlp").alias("pred_type"),
        F.when(has_calls, tc).alias("pred_tools"),
        F.when(~has_calls, F.coalesce(F.col("content"), F.lit(""))).alias("pred_response"),
        F.lit(None).cast("string").alias("pred_error"),
        F.lit("postprocessed").alias("parse_strategy"),
        F.lit(None).cast("string").alias("raw_text"),
        F.lit(None).cast("boolean").alias("raw_ok"))


def calls_from_parsed(parsed: DataFrame) -> DataFrame:
    """Predicted calls in the long form used by tool scoring."""
    return parsed.select("record_id", F.lit("pred").alias("side"),
                         F.posexplode("pred_tools").alias("ordinal", "c")).select(
        "record_id", "side", "ordinal", F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))


def parse_report(parsed: DataFrame, group_cols: list[str]) -> DataFrame:
    """O-46: rows per (group, strategy, type) with the error share."""
    return parsed.groupBy(*group_cols, "parse_strategy", "pred_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("pred_error").isNotNull().cast("double")).alias("error_share"))


def parse_failures(parsed: DataFrame, group_cols: list[str], n: int = 5, seed: int = 0) -> DataFrame:
    """O-46: the rows that a look at bad answers starts from: of every (group, strategy) the
    ``n`` error rows of smallest ``md5(record_id|seed)``, with their place (``rank``), error
    and whole raw text.  The choice depends on ids alone, so a repeated run shows the same
    rows.  Rows are ranked in two stages, the last over at most ``n`` rows a bucket; the texts
    are carried only by rows that Spark's group limit leaves."""
    key = F.md5(F.concat_ws("|", F.col("record_id").cast("string"), F.lit(str(seed))))
    bad = (parsed.filter(F.col("pred_error").isNotNull())
           .select(*group_cols, "parse_strategy", "record_id", "pred_error", "raw_text").withColumn("_key", key))
    order = [F.col("_key"), F.col("record_id"), F.col("pred_error"), F.col("raw_text")]
    return top_n_per_group(bad, [*group_cols, "parse_strategy"], order, n, "rank").drop("_key")


_MESSAGE = ("struct<role:string,content:string,tool_calls:array<struct<type:string,"
            "function:struct<name:string,arguments:string>>>>")
RESPONSE_LINE = (f"custom_id string, error string, "
                 f"response struct<status_code:int,body:struct<choices:array<struct<message:{_MESSAGE}>>>>")


def response_lines(lines: DataFrame, line: str = "line", order: str = "line_no") -> DataFrame:
    """O-26/O-31: batch answer lines (JSON text) as rows ``(record_id, content,
    tool_calls, error)``.  ``record_id`` is the line's ``custom_id`` (text); the
    answer is the message of the first choice.  Of several lines for one id the
    one with the largest ``order`` wins (then the larger text).  Lines without
    an id are dropped: they answer no request."""
    m = F.from_json(F.col(line), RESPONSE_LINE)
    message = F.get(F.col("m.response.body.choices"), F.lit(0))["message"]
    rows = lines.select(m.alias("m"), F.struct(F.col(order), F.col(line)).alias("turn")).filter("m.custom_id IS NOT NULL")
    answer = F.struct(message["content"].alias("content"), message["tool_calls"].alias("tool_calls"),
                      F.col("m.error").alias("error"))
    return (rows.groupBy(F.col("m.custom_id").alias("record_id")).agg(F.max_by(answer, "turn").alias("a"))
            .select("record_id", "a.content", "a.tool_calls", "a.error"))


def answer_lines(lines: DataFrame, requests: DataFrame, line: str = "line", order: str = "line_no",
                 key: str = "record_id") -> DataFrame:
    """O-26/O-28/O-31: every batch answer line with what becomes of it: ``(order, custom_id,
    status, content, tool_calls, error, text)``.  ``status`` is ``unreadable`` (no JSON object;
    ``text`` holds the line), ``no_id``, ``orphan`` (no request has its id), ``outdated`` (a later
    line answers the same request) or ``good``: at most one per request, so a join by key
    neither loses nor multiplies requests.  ``order`` must be unique, such as file and line."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "damaged"}
    m = F.from_json(F.col(line), RESPONSE_LINE + ", damaged string", options)
    message = F.get(F.col("m.response.body.choices"), F.lit(0))["message"]
    object_ = F.trim(F.col("text")).startswith("{") & F.col("m.damaged").isNull() & F.col("m").isNotNull()
    rows = lines.select(F.col(order), F.col(line).alias("text"), m.alias("m")).select(
        order, F.coalesce(object_, F.lit(False)).alias("readable"), "text", F.col("m.custom_id").alias("custom_id"),
        message["content"].alias("content"), message["tool_calls"].alias("tool_calls"), F.col("m.error").alias("error"))
    read = ["custom_id", "content", "tool_calls", "error"]           # of a damaged line nothing is trusted
    rows = rows.withColumns({c: F.when(F.col("readable"), F.col(c)) for c in read})
    usable = rows.filter("readable AND custom_id IS NOT NULL")
    asked = requests.select(F.col(key).cast("string").alias("custom_id")).distinct().withColumn("_asked", F.lit(True))
    newest = usable.groupBy("custom_id").agg(F.max(order).alias("_newest"))
    known = usable.join(newest.join(asked, "custom_id", "left"), "custom_id").withColumn(
        "status", F.when(F.col("_asked").isNull(), "orphan").when(F.col(order) < F.col("_newest"), "outdated").otherwise("good"))
    rest = rows.filter("NOT (readable AND custom_id IS NOT NULL)").withColumn(
        "status", F.when(F.col("readable"), "no_id").otherwise("unreadable"))
    columns = [order, "custom_id", "status", "content", "tool_calls", "error"]
    lost = F.when(F.col("status") == "unreadable", F.col("text")).alias("text")
    return known.select(*columns, lost).unionByName(rest.select(*columns, lost))


def good_answers(answers: DataFrame) -> DataFrame:
    """The lines of ``answer_lines`` that answer a request, as ``ingest_responses`` reads them."""
    return answers.filter("status = 'good'").select(F.col("custom_id").alias("record_id"), "content", "tool_calls", "error")


def ingest_responses(records: DataFrame, lines: DataFrame) -> DataFrame:
    """O-26/O-27: response lines ``(record_id, content, tool_calls)`` meet
    their requests by key (not position).  A line with any named function
    call is a tool output; otherwise its content (NULL -> '') is the answer;
    a request without a line is an empty output.  ``lines`` has one row per id
    (``response_lines``); its calls and, where present, errors are kept."""
    named = F.exists("tool_calls", lambda c: F.coalesce(F.length(c["function"]["name"]), F.lit(0)) > 0)
    j = records.join(lines.withColumn("_line", F.lit(True)), "record_id", "left")
    kind = (F.when(F.col("_line").isNull(), "empty")
            .when(F.coalesce(named, F.lit(False)), "tool").otherwise("content"))
    more = [F.col("error")] if "error" in lines.columns else [F.lit(None).cast("string").alias("error")]
    return j.select("record_id", kind.alias("output_kind"),
                    F.when(kind == "content", F.coalesce(F.col("content"), F.lit(""))).alias("content"),
                    F.when(kind == "tool", F.col("tool_calls")).alias("tool_calls"), *more)
