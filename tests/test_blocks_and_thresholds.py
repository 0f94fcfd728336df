"""Contexts from shared blocks, selection by threshold, leaf matching by key."""

import json
import random

import pytest
from pyspark.sql import functions as F

from scorecraft.functions.windows import first_n_by_threshold
from scorecraft.operators import label_metrics as L
from scorecraft.operators import records as R
from scorecraft.operators import tool_metrics as T


def conversation(n, conv_id=1):
    return [("complete", conv_id, "u", i, ["user", "assistant", "tool"][i % 3], f"text {conv_id} {i}", None) for i in range(n)]


TURNS = "category string, conv_id long, uid string, turn_idx int, role string, content string, tool_calls string"


@pytest.mark.parametrize("block", [1, 3, 4, R.BLOCK])
def test_contexts_by_definition(spark, block):
    """Whatever the block, a record's context is its sample's turns up to the trigger."""
    data = conversation(11) + conversation(3, 2) + conversation(8, 3)
    turns = spark.createDataFrame(data, TURNS).repartition(3)
    records = R.prediction_records(turns)
    got = {r.record_id: [tuple(m) for m in r.context] for r in
           R.materialise_context(records, turns, "be brief", True, block).collect()}
    want = {r.record_id: [("system", "be brief")] + [(t[4], t[5]) for t in data if t[1] == r.conv_id and t[3] <= r.trigger_turn]
            for r in records.collect()}
    assert got == want and len(got) > 10
    assert R.materialise_context(records.limit(0), turns).count() == 0


def test_text_moves_once_per_turn(spark):
    """The rows shuffled for one long conversation grow with its turns, not with their square."""
    def gathered(n):
        turns = spark.range(n).select(F.lit("nlp").alias("category"), F.lit(1).cast("long").alias("conv_id"), F.lit("u").alias("uid"),
                                      F.col("id").cast("int").alias("turn_idx"), F.lit("user").alias("role"),
                                      F.concat(F.lit("t"), "id").alias("content"), F.lit(None).cast("string").alias("tool_calls"))
        records = turns.filter("turn_idx % 100 = 0").select(F.col("turn_idx").cast("string").alias("record_id"), *R.SAMPLE,
                                                             F.col("turn_idx").alias("trigger_turn"))
        out = R.materialise_context(records, turns, block=1000)
        assert out.filter(F.size("context") != F.col("record_id").cast("int") + 1).count() == 0
        return out

    plan = gathered(5000)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(sequence" not in plan                     # no row per (record, turn)


@pytest.mark.parametrize("n", [0, 1, 7, 300, 5000])
def test_first_n_by_threshold(spark, n):
    random.seed(n)
    data = [(random.choice("aaaab"), random.choice([random.randint(-10**6, 10**6), random.randint(-2**60, 2**60), 5]), i) for i in range(2000)]
    df = spark.createDataFrame(data, "g string, v long, id int").repartition(5)
    quotas = spark.createDataFrame([("a", n), ("b", max(0, n - 3)), ("c", 1)], "g string, quota long")
    got = sorted(map(tuple, first_n_by_threshold(df, ["g"], F.col("v"), quotas, rounds=2, ranges=16).collect()))
    want = sorted(x for g, k in (("a", n), ("b", max(0, n - 3))) for x in
                  sorted((d for d in data if d[0] == g), key=lambda d: (d[1], d[0], d[1], d[2]))[:k])
    assert got == want


def test_balanced_rows_are_filtered_not_ranked(spark):
    """100,000 rows of two labels: the only window is over the last range's rows."""
    df = spark.range(100_000).select("id", F.when(F.col("id") % 10 == 0, "unsafe").otherwise("safe").alias("label"))
    got = L.balanced_subset(df, "label", "id", n=20_000)
    assert {r["label"]: r["count"] for r in got.groupBy("label").count().collect()} == {"safe": 10_000, "unsafe": 10_000}
    assert got.columns[1:] == ["id", "label"] or set(got.columns) >= {"id", "label"}
    few = L.balanced_subset(df, "label", "id", n=50)
    all_ = few.select("id").join(got.select("id"), "id", "left_anti")
    assert few.count() == 50 and all_.count() == 0                     # the smallest hashes first


def wide(spark, truth, pred, params=("a",), gt_type="tool"):
    items = spark.createDataFrame([(1, gt_type, "tool")], "record_id long, gt_type string, pred_type string")
    rows = [(1, "gt", i, n, a) for i, (n, a) in enumerate(truth)] + [(1, "pred", i, n, a) for i, (n, a) in enumerate(pred)]
    calls = spark.createDataFrame(rows, "record_id long, side string, ordinal int, name string, arguments string")
    tools = spark.createDataFrame([("t",), ("u",)], "name string")
    dim = spark.createDataFrame([(t, p) for t in "tu" for p in params], "tool string, param string")
    one = T.tool_scores_wide(items, calls, tools, dim).collect()
    nested = items.withColumn("pred_tools", F.from_json(F.lit(json.dumps([{"name": n, "arguments": a} for n, a in pred])),
                                                        "array<struct<name:string,arguments:string>>"))
    assert T.tool_scores_wide(nested, calls.filter("side = 'gt'"), tools, dim).collect() == one
    return one[0]


def test_leaves_meet_by_key(spark):
    """Calls among the rows or nested in the items; names that collide when dotted; a call
    repeated by name; records of many leaves."""
    r = wide(spark, [("t", '{"a": 1, "b": {"c": "X"}}'), ("u", "{}")], [("u", "{}"), ("t", '{"a": 1.0, "b": {"c": "x"}, "d": 2}')],
             params=("a", "b"))
    assert (r.score_exact_match, r.score_tool_pick_up_rate, r.score_variable_pickup_rate) == (1.0, 1.0, None)
    r = wide(spark, [("t", '{"a": 1, "z": 2}')], [("t", '{"a": 9}'), ("t", '{"a": 1, "q": 3}')])
    assert (r.score_variable_pickup_rate, r.score_variable_correct_rate, r.score_variable_hallucination_rate) == (0.5, 0.5, 0.5)
    r = wide(spark, [("t", '{"a.b": 1, "a": {"b": 2}}')], [("t", '{"a": {"b": 2}}')])
    assert (r.score_variable_correct_rate, r.score_exact_match) == (0.5, 0.0)
    n = 20_000
    r = wide(spark, [("t", json.dumps({f"k{i}": i for i in range(n)}))], [("t", json.dumps({f"k{i}": i + (i % 4 == 0) for i in range(n)}))],
             params=tuple(f"k{i}" for i in range(n // 2)))
    assert (r.score_variable_pickup_rate, r.score_variable_correct_rate, r.score_variable_hallucination_rate) == (0.5, 0.375, 0.5)
