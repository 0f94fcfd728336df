"""Output parsing (O-34..O-46): the per-row ladder and the Spark stage."""

import json

import pytest

from scorecraft.functions.output_parser import parse_text, raw_ok
from scorecraft.operators import parsing as P

FENCE = "`" * 3


@pytest.mark.parametrize("text,kind,name,strategy", [
    ('{"tool_calls":{"name":"show_pie_chart","args":{"limit":5}}}', "tool", "show_pie_chart", "json_tolerant"),
    (FENCE + 'json\n{"name":"show_pie_chart","parameters":{"limit":5}}\n' + FENCE, "tool", "show_pie_chart", "json_fenced"),
    ('[{"show_line_chart":{"metric":"balance"}}]', "tool", "show_line_chart", "json_strict"),
    ('Sure: {"name":"show_pie_chart","parameters":{"limit":5}} done', "tool", "show_pie_chart", "json_substring"),
    ('{"content":"hello"}', "nlp", None, "json_tolerant"),
    ('{"name":"show_pie_chart","arguments":{"limit":5}}', "tool", "show_pie_chart", "json_strict"),
    ('{"tool_calls":[{"function":{"name":"x","arguments":"{\\"a\\": 1}"}}]}', "tool", "x", "json_strict"),
    ('{"tool_calls":{"name":"show_pie_chart","args":{"limit":5}', "tool", "show_pie_chart", "json_tolerant"),
    ("[show_pie_chart(limit=5)]", "nlp", None, "text_fallback"),
    ("   ", "error", None, "empty"),
])
def test_json_ladder(text, kind, name, strategy):
    k, tools, resp, err, strat, _ = parse_text(text, "json")
    assert (k, strat) == (kind, strategy)
    if name:
        assert tools[0][0] == name
    if kind == "nlp" and "hello" in text:
        assert resp == "hello"


def test_pythonic_calls_and_fixers():
    k, tools, *_ = parse_text("Okay.\n\n[show_pie_chart(limit=5, data_source={data_type=spending}, title=My chart)]",
                              "pythonic")
    assert k == "tool"
    assert tools == [("show_pie_chart", {"limit": 5, "data_source": {"data_type": "spending"}, "title": "My chart"})]
    k, tools, *_ = parse_text(FENCE + "tool_code\nshow_line_chart(metric='balance', n=-2)\n" + FENCE, "pythonic")
    # an unquoted value that starts with neither a digit nor a bracket is text
    assert tools == [("show_line_chart", {"metric": "balance", "n": "-2"})]
    k, tools, *_ = parse_text("[f(x='{\"a\": [1]}')]", "pythonic")
    assert tools[0][1] == {"x": {"a": [1]}}
    assert parse_text("plain words", "pythonic")[0] == "nlp"


@pytest.mark.parametrize("text, calls", [
    ("[f(a=[1, 2.5, -3, True, None], b={'k': (1, 'x')})]", [("f", {"a": [1, 2.5, -3, True, None], "b": {"k": [1, "x"]}})]),
    ("[f(a=g(b=1)), mod.h()]", [("f", {"a": {"b": 1}}), ("mod.h", {})]),
    ("[f(\u201cpositional\u201d, a=\u2018x\u2019)]", [("f", {"a": "x"})]),
    ("[f(a='{\"k\": 1}, b=2)]", [("f", {"a": {"k": 1}, "b": 2})]),
    ("[f(a=New York, USA, b={c=one two, d='x'})]", [("f", {"a": "New York, USA", "b": {"c": "one two", "d": "x"}})]),
    ("[f(day=2024-01-02)]", [("f", {"day": "2024-01-02"})]),
    ("text [1] then [f(a='it\\'s')] end", [("f", {"a": "it's"})]),
    ("[[f(a=1)]", [("f", {"a": 1})]),
])
def test_call_syntax(text, calls):
    kind, tools, _, _, strategy, _ = parse_text(text, "pythonic")
    assert (kind, tools, strategy) == ("tool", calls, "pythonic")


HOSTILE = ["[" * 100_000, '{"a":' * 50_000, '{"content":"\\ud83d"}', "[f(x={1,2})]", "[f(x=b'ab')]", "[f(x=1j)]", "f(" * 5_000,
           "[f(x=" + "9" * 10_000 + ")]", '{"tool_calls":[1,{"function":3}]}', "[f(" + "a" * 100_000, "{" * 1000 + "}" * 999]


@pytest.mark.parametrize("parser", ["json", "pythonic"])
def test_hostile_answers_end_as_rows(spark, parser):
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(HOSTILE)],
                               "record_id long, content string, tool_calls array<struct<type:string,"
                               "function:struct<name:string,arguments:string>>>, error string")
    got = P.parse_outputs(df, parser).collect()
    assert len(got) == len(HOSTILE) and {r.pred_type for r in got} <= {"tool", "nlp", "error"}


def test_raw_validity():
    assert raw_ok(' {"a": 1} ') and raw_ok("[f(a=1)]") and raw_ok("g()") and raw_ok("12")
    assert not raw_ok("{data_type=x}") and not raw_ok("hello world") and not raw_ok('{"a":1} tail')


def test_spark_stage(spark):
    calls_t = "array<struct<type:string,function:struct<name:string,arguments:string>>>"
    df = spark.createDataFrame([
        (1, None, None, "timeout"),
        (2, None, [("function", ("show_pie_chart", '{"limit": 3}'))], None),
        (3, None, [("function", ("show_pie_chart", "{bad"))], None),
        (4, "  just text  ", None, None),
        (5, "", None, None),
        (6, '{"name":"show_pie_chart","parameters":{"limit":5}}', None, None),
        (7, "42", None, None),
    ], f"record_id long, content string, tool_calls {calls_t}, error string")
    got = {r.record_id: r for r in P.parse_outputs(df, "json").collect()}
    assert got[1].pred_type == "error" and got[1].pred_error == "timeout" and got[1].raw_text == ""
    assert got[2].pred_type == "tool" and json.loads(got[2].pred_tools[0].arguments) == {"limit": 3}
    assert got[3].pred_type == "error"
    assert got[4].pred_type == "nlp" and got[4].pred_response == "just text" and got[4].raw_ok is False
    assert got[5].pred_type == "error" and got[5].pred_error == "empty output"
    assert got[6].pred_type == "tool" and got[6].parse_strategy == "json_strict"
    assert got[7].raw_ok is True
    with pytest.raises(ValueError):
        P.parse_outputs(df, "xml")


def test_answer_lines_by_status(spark):
    """Unreadable, id-less, orphaned, outdated and good lines; each request answered at most once."""
    from scorecraft.operators import exchange as X

    def line(i, text):
        return '{"custom_id":"%s","response":{"body":{"choices":[{"message":{"content":"%s"}}]}}}' % (i, text)

    lines = [(1, line("a", "old")), (2, line("a", "new")), (3, line("zz", "?")), (4, line("b", "b")[:-3]), (5, "[1]"), (6, ""),
             (7, None), (8, "not json"), (9, '{"response":null}'), (10, '{"custom_id":"c","error":"late"}'), (11, "  " + line("b", "kept"))]
    df = spark.createDataFrame(lines, "line_no int, line string")
    requests = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("d",)], "record_id string")
    found = {r.line_no: r for r in P.answer_lines(df, requests).collect()}
    assert {n: r.status for n, r in found.items()} == {
        1: "outdated", 2: "good", 3: "orphan", 4: "unreadable", 5: "unreadable", 6: "unreadable", 7: "unreadable", 8: "unreadable",
        9: "no_id", 10: "good", 11: "good"}
    assert found[4].text == lines[3][1] and found[4].custom_id is None and found[2].text is None and found[10].error == "late"
    out = P.ingest_responses(requests.distinct(), P.good_answers(P.answer_lines(df, requests))).collect()
    assert sorted((r.record_id, r.output_kind, r.content) for r in out)[0] == ("a", "content", "new") and len(out) == 4
    assert P.answer_lines(df.limit(0), requests).count() == 0
    judged = spark.createDataFrame([("a", "m", "binary"), ("b", "m", "score_1_5")], "record_id string, metric string, output_type string")
    answers = spark.createDataFrame([(1, line("a|m", "1")), (2, line("a|m", "0")), (3, line("b|m", "4")), (4, line("b|m", "4")[:-1])], "line_no int, line string")
    assert sorted(map(tuple, X.judge_scores_from_lines(judged, answers).collect())) == [("a", "m", "binary", 0.0), ("b", "m", "score_1_5", 4.0)]
