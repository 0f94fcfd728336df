"""Guardrail metrics (O-53, O-76..O-81, O-22) and run analysis (O-09, O-82..O-88)."""

import math

import pytest
from pyspark.sql import functions as F

from scorecraft import sinks
from scorecraft.operators import analysis as A
from scorecraft.operators import label_metrics as L
from scorecraft.sources.runs import detect_benchmark, latest_run_per_model, scan_runs


def labelled(spark):
    # gt, raw output
    data = [("unsafe", "unsafe"), ("unsafe", " Safe\n"), ("safe", "UNSAFE"), ("safe", "safe"),
            ("safe", "safe"), ("unsafe", "maybe")]
    return spark.createDataFrame([(i, g, o) for i, (g, o) in enumerate(data)], "sample_id long, ground_truth_label string, output string")


def test_guardrail_metrics(spark):
    v, d = L.split_valid(labelled(spark))
    assert d.count() == 1
    m = L.classification_metrics(v).collect()[0]
    # valid: (u,u) (u,s) (s,u) (s,s) (s,s): tp=1 fp=1 fn=1 tn=2
    assert (m.true_positives, m.false_positives, m.false_negatives, m.true_negatives) == (1, 1, 1, 2)
    assert m.accuracy == pytest.approx(0.6) and m.precision == 0.5 and m.recall == 0.5 and m.f1 == 0.5
    empty = L.classification_metrics(v.limit(0)).collect()[0]
    assert (empty.accuracy, empty.precision, empty.recall, empty.f1) == (0.0, 0.0, 0.0, 0.0)


def test_classification_report(spark):
    v, _ = L.split_valid(labelled(spark))
    rep = {r.label: r for r in L.classification_report(v).collect()}
    assert rep["safe"].support == 3 and rep["unsafe"].support == 2
    assert rep["safe"].precision == pytest.approx(2 / 3) and rep["safe"].recall == pytest.approx(2 / 3)
    assert rep["accuracy"].f1 == pytest.approx(0.6)
    assert rep["macro avg"].f1 == pytest.approx((2 / 3 + 0.5) / 2)
    assert rep["weighted avg"].recall == pytest.approx((2 / 3 * 3 + 0.5 * 2) / 5)


def test_balanced_subset(spark):
    df = spark.range(0, 50).select(F.col("id").alias("sid"),
                                   F.when(F.col("id") < 7, "unsafe").otherwise("safe").alias("label"))
    s = L.balanced_subset(df, "label", "sid", n=100, seed=1)
    counts = {r.label: r["count"] for r in s.groupBy("label").count().collect()}
    assert counts == {"unsafe": 7, "safe": 7}
    again = L.balanced_subset(df.repartition(4), "label", "sid", n=100, seed=1)
    assert sorted(r.sid for r in s.collect()) == sorted(r.sid for r in again.collect())
    assert L.balanced_subset(df, "label", "sid", n=5, seed=1).count() == 4


def test_summary_and_axis(spark):
    df = spark.createDataFrame([("m", 1.0, None), ("m", 3.0, 0.02), ("m", None, 0.04)],
                               "model string, score_a double, score_b double")
    s = {r.metric: r for r in A.metric_summary(df, ["model"]).collect()}
    assert s["a"].num_samples == 3 and s["a"].mean == 2.0 and s["a"].median == 2.0
    assert s["a"].std == pytest.approx(math.sqrt(2))
    means = A.model_means(df)
    ax = A.negative_axis_max(means, ["b"]).collect()[0]
    # x = 0.03 -> (floor(0.033 / 0.02) + 1) * 0.02 = 0.04
    assert ax.axis_max == pytest.approx(0.04)
    assert A.negative_axis_max(means, ["none"]).collect()[0].axis_max == 0.1


def test_runs_round_trip(spark, tmp_path):
    root = str(tmp_path / "runs")
    for ts, model, v in [("2026-01-01_00-00-00", "m0", 0.0), ("2026-01-02_00-00-00", "m0", 1.0),
                         ("2026-01-01_00-00-00", "m1", 0.5)]:
        df = spark.createDataFrame([(1, v), (2, v)], "record_id long, score_exact_match double")
        sinks.write_per_item_results(df, root, ts, model, "tool_calling", csv=True)
    runs = scan_runs(spark, root, "tool_calling")
    assert runs.count() == 6 and set(r.benchmark for r in runs.collect()) == {"tool_calling"}
    latest = {(r.model, r.score_exact_match) for r in latest_run_per_model(runs).collect()}
    assert latest == {("m0", 1.0), ("m1", 0.5)}
    keyed = {r.model for r in latest_run_per_model(runs, include_timestamp=True).collect()}
    assert "2026-01-01_00-00-00_m0" in keyed and len(keyed) == 3
    cmp = {r.model: r for r in A.model_comparison(latest_run_per_model(runs)).collect()}
    assert cmp["m0"].exact_match_mean == 1.0 and cmp["m1"].num_samples == 2


def test_detect_benchmark(spark):
    df = spark.createDataFrame([("/x/Content/a",), ("/y/guardrailing/b",), ("/z",)], "p string")
    assert [r.b for r in df.select(detect_benchmark(F.col("p")).alias("b")).collect()] == ["content", "guardrailing", None]
