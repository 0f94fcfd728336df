"""Sources (O-01, O-02, O-08), exchange tables (O-23, O-30..O-33), the driver
contract, and a DuckDB oracle spot check on sf0.001."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from scorecraft.operators import exchange as X
from scorecraft.sources.datasets import load_dataset, load_dataset_lines, normalise_legacy
from scorecraft.sources.guardrail import load_guardrail_rows
from scorecraft.sources.tables import TABLES

SF_SMALL = "/root/testdata/sf0.001"


def test_load_dataset(spark, tmp_path):
    doc = {"incomplete": [{"uid": "a1", "metadata": {"age": 3},
                           "messages": [{"role": "user", "content": "q"},
                                        {"role": "assistant", "tool_call": {"name": "t", "arguments": {"x": 1}}},
                                        {"role": "tool", "content": "r"}]}],
           "nlp": "not a list",
           "complete": [{"uid": "c1", "messages": [{"role": "user", "content": "q1"}]},
                        {"uid": "c2", "messages": [{"role": "user", "content": "q2"}]}]}
    p = tmp_path / "d.json"
    p.write_text(json.dumps(doc))
    t = load_dataset(spark, str(p))
    got = sorted((r.category, r.conv_id, r.turn_idx, r.role) for r in t.collect())
    assert got == [("complete", 0, 0, "user"), ("complete", 1, 0, "user"), ("incomplete", 0, 0, "user"),
                   ("incomplete", 0, 1, "assistant"), ("incomplete", 0, 2, "tool")]
    call = t.filter("role = 'assistant'").collect()[0].tool_calls
    assert json.loads(call) == {"name": "t", "arguments": {"x": 1}}
    assert load_dataset(spark, str(p), max_samples=1).filter("category = 'complete'").count() == 1
    lines = tmp_path / "d.jsonl"
    lines.write_text(json.dumps({"category": "nlp", "sample_idx": 0, "uid": "n",
                                 "messages": [{"role": "user", "content": "x"}]}) + "\n")
    assert load_dataset_lines(spark, str(lines)).count() == 1


def test_guardrail_loader(spark, tmp_path):
    p = tmp_path / "g.jsonl"
    p.write_text("\n".join(json.dumps({"prompt": f"p{i}", "prompt_label": "safe", "violated_categories": ""})
                           for i in range(5)))
    assert load_guardrail_rows(spark, str(p), max_samples=2).count() == 2
    p2 = tmp_path / "bad.jsonl"
    p2.write_text(json.dumps({"prompt": "x"}))
    with pytest.raises(Exception, match="missing required field"):
        load_guardrail_rows(spark, str(p2)).collect()


def test_legacy_layout(spark):
    conv = [{"query": "q1", "ground_truth": {"type": "tool", "tools": [{"tool": "pie", "parameters": {"a": 1}}]}},
            {"query": "q2", "ground_truth": {"type": "nlp", "response": "r2"}}]
    df = spark.createDataFrame([("c", json.dumps(conv))], "conv_id string, doc string")
    t = sorted((r.turn_idx, r.role, r.content, r.tool_calls) for r in normalise_legacy(df).collect())
    assert [x[:3] for x in t] == [(0, "user", "q1"), (1, "assistant", None), (2, "user", "q2"), (3, "assistant", "r2")]
    assert json.loads(t[1][3]) == [{"name": "pie", "arguments": '{"a":1}'}]


def test_judge_tables(spark):
    items = spark.createDataFrame([("r1", "ref {prediction}", "pred", None)],
                                  "record_id string, reference_text string, prediction_text string, query string")
    req = {r.metric: r for r in X.judge_requests(
        items, ["content_similarity", "content_helpfulness", "nope"],
        [X.JudgePrompt("content_similarity", "score_1_5", "sys", "R: {reference} P: {prediction}"),
         X.JudgePrompt("content_helpfulness", "score_1_5", "sys", "Q: {query}!")]).collect()}
    assert set(req) == {"content_similarity", "content_helpfulness"}
    # single-pass formatting: a placeholder inside a value is left alone
    assert req["content_similarity"].user_prompt == "R: ref {prediction} P: pred"
    assert json.loads(req["content_helpfulness"].request)["body"]["messages"][1]["content"] == "Q: !"
    out = spark.createDataFrame([("r1", "content_similarity", " 7 ")], "record_id string, metric string, output string")
    reqs = spark.createDataFrame([("r1", "content_similarity", "score_1_5"), ("r1", "context_accuracy", "binary")],
                                 "record_id string, metric string, output_type string")
    s = {r.metric: r.score for r in X.judge_scores(reqs, out).collect()}
    assert s == {"content_similarity": 5.0, "context_accuracy": 0.0}
    piv = X.judge_scores_pivot(X.judge_scores(reqs, out), ["content_similarity", "context_accuracy", "topic_accuracy"])
    row = piv.collect()[0]
    assert row.content_similarity == 5.0 and row.topic_accuracy is None


def test_judge_numbers(spark):
    """Numbers as Python's float() reads them."""
    cases = {"4": 4, " 1_0 ": 5, "5d": 3, "1f": 3, "nan": 5, "-inf": 1, "2.": 2, ".5": 1, "\u00a03\u2003": 3, "1e0": 1, "": 3, "4 5": 3}
    df = spark.createDataFrame(list(cases.items()), "output string, want int")
    got = df.select("want", X.parse_judge_score(F.col("output"), F.lit("score_1_5")).alias("s")).collect()
    assert [r.s for r in got] == [float(r.want) for r in got]


def test_entry_contract(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["category", "gt_role", "n_records", "mean_context_turns"]
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50


@pytest.mark.parametrize("name", ["prediction_records", "tool_scores_wide", "guardrail_comparison",
                                  "parse_outputs_types", "rouge1", "metric_summary", "arg_domain_violations",
                                  "response_lines_parsed", "content_scores_wide"])
def test_oracle_spot_check(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    df = E.queries()[name](spark, SF_SMALL)
    got = df.select(*cols).collect()

    def norm(r):
        return tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(norm, got), key=repr) == sorted(map(norm, want), key=repr)
