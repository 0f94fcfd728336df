"""Per-item rows and predictions, written and read back (O-92, O-93)."""

import json

from scorecraft.operators import parsing as P
from scorecraft.operators import results as S
from scorecraft.sinks import write_jsonl, write_per_item_results
from scorecraft.sources.runs import scan_runs

CALLS = "array<struct<type:string,function:struct<name:string,arguments:string>>>"


def tables(spark):
    records = spark.createDataFrame(
        [("r1", "u1", "nlp", 2, 3, "assistant", "the truth", None), ("r2", "u2", "complete", 0, 1, "assistant", None, '[{"name":"t"}]')],
        "record_id string, uid string, category string, trigger_turn int, gt_turn_index int, gt_role string, "
        "gt_content string, gt_tool_calls string")
    outputs = spark.createDataFrame([("r1", "said", None, None), ("r2", None, [("function", ("t", "{}"))], None)],
                                    f"record_id string, content string, tool_calls {CALLS}, error string")
    scores = spark.createDataFrame([("r1", 1.0), ("r2", 0.5)], "record_id string, score_exact_match double")
    return records, outputs, P.parse_outputs(outputs), scores


def test_item_rows_round_trip(spark, tmp_path):
    records, outputs, parsed, scores = tables(spark)
    rows = S.tool_item_rows(records, parsed, scores, outputs)
    write_per_item_results(rows, str(tmp_path), "2026-01-01_00-00-00", "m", "tool_calling")
    got = {r.uid: r for r in scan_runs(spark, str(tmp_path), "tool_calling").collect()}
    assert got["u1"].turn_indices == "[0,1,2]" and got["u1"].gt_value == "the truth" and got["u1"].pred_response == "said"
    assert got["u2"].gt_type == "tool" and json.loads(got["u2"].pred_tools) == [{"name": "t", "arguments": "{}"}]
    assert got["u2"].score_exact_match == 0.5 and json.loads(got["u1"].raw_output) == {"content": "said"}
    assert got["u1"].model == "m"


def test_predictions(spark, tmp_path):
    records, outputs, parsed, scores = tables(spark)
    contexts = spark.createDataFrame([("r1", [("user", "q")])], "record_id string, context array<struct<role:string,content:string>>")
    write_jsonl(S.tool_predictions(records, contexts, outputs, parsed, scores), str(tmp_path / "p"))
    got = {r.uid: r for r in spark.read.json(str(tmp_path / "p")).collect()}
    assert got["u1"].context[0].content == "q" and got["u1"].scores.exact_match == 1.0
    assert got["u2"].parsed_output.type == "tool" and got["u1"].turn_indices == [0, 1, 2]
    assert "scores" not in S.tool_predictions(records, contexts, outputs, parsed).columns
    labels = spark.createDataFrame([(1, "p", "safe", None, " Safe ", "safe")], "sample_id int, prompt string, prompt_label string, "
                                   "violated_categories string, output string, predicted_label string")
    assert S.label_item_rows(labels).collect()[0].correct
    assert "raw_output" not in S.label_item_rows(labels, include_raw=False).columns
    assert "prompt" not in S.label_predictions(labels, include_prompts=False).columns
