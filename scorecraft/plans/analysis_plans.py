"""Plans over per-item scores of several runs and models (fixture F-E):
O-09, O-82..O-88."""

from __future__ import annotations


from scorecraft.operators import analysis as A
from scorecraft.plans.fixtures import fixture, fixture_sql
from scorecraft.plans.registry import register, round_doubles, rounded_sql
from scorecraft.sources.runs import latest_run_per_model

SCORES = ["exact_match", "variable_correct_rate", "tool_hallucination_rate", "content_similarity",
          "levenshtein_distance"]
POSITIVE = ["exact_match", "variable_correct_rate", "content_similarity"]
NEGATIVE = ["tool_hallucination_rate", "levenshtein_distance"]


def latest(spark, sf_dir):
    return latest_run_per_model(fixture(spark, sf_dir, "run_scores"))


_BASE = "WITH e AS (" + fixture_sql("run_scores") + """)
, latest AS (SELECT e.* FROM e JOIN (SELECT model, max(run_ts) AS run_ts FROM e GROUP BY model) m USING (model, run_ts))
, long AS (UNPIVOT latest ON """ + ", ".join(f"score_{m}" for m in SCORES) + """ INTO NAME metric VALUE value)
"""
# DuckDB's UNPIVOT drops NULL values; the Spark side keeps them, so the
# oracle counts rows from ``latest`` directly.
_MEANS = """
, means AS (SELECT model, replace(metric, 'score_', '') AS metric, avg(value) AS mean FROM long GROUP BY 1, 2)
"""


@register("runs_latest_per_model", oracle=_BASE + "SELECT run_ts, model, record_id FROM latest")
def runs_latest_per_model(spark, sf_dir):
    return latest(spark, sf_dir).select("run_ts", "model", "record_id")


@register("metric_summary", oracle=rounded_sql(_BASE + """
, n AS (SELECT model, count(*) AS num_samples FROM latest GROUP BY model)
SELECT model, replace(metric, 'score_', '') AS metric, n.num_samples, avg(value) AS mean, stddev_samp(value) AS std,
       min(value) AS min, max(value) AS max, median(value) AS median
FROM long JOIN n USING (model) GROUP BY model, metric, n.num_samples""",
    ["model", "metric", "num_samples", "mean", "std", "min", "max", "median"], {"mean", "std", "min", "max", "median"}))
def metric_summary(spark, sf_dir):
    return round_doubles(A.metric_summary(latest(spark, sf_dir).drop("run_ts", "record_id"), ["model"]))


_CMP_DOUBLES = [f"{m}_{s}" for m in SCORES for s in ("mean", "std")]


@register("model_comparison", oracle=rounded_sql(_BASE + "SELECT model, count(*) AS num_samples, " + ", ".join(
    f"avg(score_{m}) AS {m}_mean, stddev_samp(score_{m}) AS {m}_std" for m in SCORES) + " FROM latest GROUP BY model",
    ["model", "num_samples", *_CMP_DOUBLES], set(_CMP_DOUBLES)))
def model_comparison(spark, sf_dir):
    return round_doubles(A.model_comparison(latest(spark, sf_dir).drop("run_ts", "record_id")))


@register("rows_with_any_metric", oracle=_BASE + """
SELECT run_ts, model, record_id FROM e WHERE coalesce(score_exact_match, score_variable_correct_rate) IS NOT NULL""")
def rows_with_any_metric(spark, sf_dir):
    e = fixture(spark, sf_dir, "run_scores")
    return A.rows_with_any_metric(e, ["exact_match", "variable_correct_rate", "topic_accuracy"]).select(
        "run_ts", "model", "record_id")


@register("normalised_metrics", oracle=rounded_sql(_BASE + _MEANS + """
SELECT model, metric, mean,
       CASE WHEN metric IN ('content_similarity', 'content_helpfulness') THEN (mean - 1.0) / 4.0
            WHEN metric = 'levenshtein_distance' THEN
                 CASE WHEN max(mean) OVER (PARTITION BY metric) > 0 THEN mean / max(mean) OVER (PARTITION BY metric) ELSE 0.0 END
            ELSE mean END AS normalised
FROM means""", ["model", "metric", "mean", "normalised"], {"mean", "normalised"}))
def normalised_metrics(spark, sf_dir):
    return round_doubles(A.normalised_metrics(A.model_means(latest(spark, sf_dir).drop("run_ts", "record_id"))))


_DIM = " UNION ALL ".join(
    [f"SELECT '{m}' AS metric, 'higher' AS direction, {i} AS ord" for i, m in enumerate(POSITIVE)]
    + [f"SELECT '{m}', 'lower', {len(POSITIVE) + i}" for i, m in enumerate(NEGATIVE)])


@register("metric_direction_report", oracle=rounded_sql(_BASE + _MEANS + f"""
, dim AS ({_DIM})
SELECT model, metric, direction, ord, mean FROM means JOIN dim USING (metric)""",
    ["model", "metric", "direction", "ord", "mean"], {"mean"}))
def metric_direction_report(spark, sf_dir):
    means = A.model_means(latest(spark, sf_dir).drop("run_ts", "record_id"))
    return round_doubles(A.metric_direction_report(means, A.metric_dim(spark, POSITIVE, NEGATIVE)))


@register("negative_axis_max", oracle=rounded_sql(_BASE + _MEANS + """
, x AS (SELECT max(mean) AS x FROM means WHERE metric IN ('tool_hallucination_rate'))
SELECT x AS max_negative_mean,
       CASE WHEN coalesce(x, 0.0) = 0 THEN 0.1
            WHEN x < 0.1 THEN (floor(x * 1.1 / 0.02) + 1) * 0.02
            ELSE (floor(x * 1.1 / 0.05) + 1) * 0.05 END AS axis_max FROM x""",
    ["max_negative_mean", "axis_max"], {"max_negative_mean", "axis_max"}))
def negative_axis_max(spark, sf_dir):
    means = A.model_means(latest(spark, sf_dir).drop("run_ts", "record_id"))
    return round_doubles(A.negative_axis_max(means, ["tool_hallucination_rate"]))
