"""Configuration readers and output normalisation (O-03 YAML, O-06, O-24,
O-26/O-27, O-98)."""

import json

from scorecraft import sinks
from scorecraft.operators import exchange as X
from scorecraft.sources.catalog import catalog_documents, tool_params_dim
from scorecraft.sources.runs import load_inference_outputs

CALLS_T = "array<struct<type:string,function:struct<name:string,arguments:string>>>"


def test_yaml_catalog_and_prompts(spark, tmp_path):
    cat = tmp_path / "tools.yaml"
    cat.write_text("tools:\n  - name: pie\n    properties:\n      limit: {type: integer}\n      title: {type: string}\n")
    p = sorted((r.tool, r.param, r.type) for r in tool_params_dim(catalog_documents(spark, str(cat))).collect())
    assert p == [("pie", "limit", "integer"), ("pie", "title", "string")]
    prompts = tmp_path / "judge.yaml"
    prompts.write_text("prompts:\n  sim:\n    description: d\n    system_prompt: s\n"
                       "    user_prompt: 'R: {reference} P: {prediction}'\n    output_type: score_1_5\n    metric_name: sim\n")
    (jp,) = X.judge_prompts_from_yaml(str(prompts))
    assert (jp.metric_name, jp.output_type, jp.user_prompt) == ("sim", "score_1_5", "R: {reference} P: {prediction}")


def test_normalise_outputs(spark):
    df = spark.createDataFrame([
        (1, '{"tool_calls": {"name": "pie", "args": {"a": 1}}}', None, None),
        (2, ' {"content": "hi"}', None, None),
        (3, '{"classification": "unsafe"}', None, None),
        (4, "plain", [("function", ("pie", "{}"))], None),
        (5, None, None, "boom"),
    ], f"record_id long, content string, tool_calls {CALLS_T}, error string")
    on = {r.record_id: r for r in X.normalise_outputs(df, True, "online").collect()}
    assert on[1].tool_calls[0].function.name == "pie" and json.loads(on[1].tool_calls[0].function.arguments) == {"a": 1}
    assert on[2].content == "hi" and on[3].content == '{"classification": "unsafe"}'
    assert on[4].tool_calls[0].function.name == "pie" and on[4].content is None
    assert on[5].error == "boom" and on[5].content is None
    batch = {r.record_id: r.content for r in X.normalise_outputs(df, True, "batch").collect()}
    assert batch[3] == "unsafe" and batch[2] == ' {"content": "hi"}'


def test_online_bodies(spark):
    ctx = spark.createDataFrame([("r", [("user", "q")])], "record_id string, context array<struct<role:string,content:string>>")
    schema, tools = json.dumps({"type": "object"}), json.dumps([{"type": "function"}])
    with_schema = json.loads(X.online_bodies(ctx, "m", answer_schema=schema, tools_json=tools, backend="b").collect()[0].body)
    assert with_schema["structured_outputs"] == {"json": {"type": "object"}, "backend": "b"} and "tools" not in with_schema
    with_tools = json.loads(X.online_bodies(ctx, "m", stop=["x"], tools_json=tools).collect()[0].body)
    assert with_tools["tool_choice"] == "auto" and with_tools["stop"] == ["x"] and "structured_outputs" not in with_tools


def test_structured_requests(spark):
    ctx = spark.createDataFrame([("r1", [("user", "q")])], "record_id string, context array<struct<role:string,content:string>>")
    line = json.loads(X.structured_requests(ctx, "m", ["safe", "unsafe"]).collect()[0].request)
    assert line["body"]["response_format"]["json_schema"]["schema"]["properties"]["classification"]["enum"] == ["safe", "unsafe"]
    assert "tools" not in line["body"]


def test_load_inference_outputs(spark, tmp_path):
    run = str(tmp_path / "run")
    recs = spark.createDataFrame([("r1", "m", "2026")], "record_id string, model string, run_ts string")
    sinks.write_partitioned(recs, run + "/records", ["run_ts", "model"])
    sinks.write_partitioned(recs, run + "/responses", ["run_ts", "model"])
    r, o, g = load_inference_outputs(spark, run)
    assert r.count() == 1 and o.count() == 1 and g is None
