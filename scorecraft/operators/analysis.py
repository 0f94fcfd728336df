"""Run-level analysis (O-82..O-90): summaries and model comparisons.

Every summary is a ``groupBy`` over the per-item scores (partial aggregation
before the shuffle).  Metric-level tables (models x metrics rows) are tiny;
windows over them are the only unpartitioned windows here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorecraft.functions.partitioning import bounded_broadcast

# Fixed metric lists and directions (values that must match the reference's
# analysis output).
TOOL_POSITIVE_METRICS = ["when2call", "schema_reliability_raw", "schema_reliability_processed",
                         "tool_pick_up_rate", "variable_pickup_rate", "variable_correct_rate", "exact_match"]
TOOL_NEGATIVE_METRICS = ["tool_hallucination_rate", "tool_additional_rate",
                         "variable_hallucination_rate", "variable_additional_rate"]
CONTENT_METRICS = ["levenshtein_ratio", "rouge1", "rougeL", "bert_precision", "bert_recall", "bert_f1",
                   "content_similarity", "context_accuracy", "content_politeness", "content_helpfulness"]
CONTENT_LOWER_IS_BETTER = ["levenshtein_distance"]
ONE_TO_FIVE_METRICS = ["content_similarity", "content_helpfulness"]


def score_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("score_")]


def long_scores(df: DataFrame, id_cols: list[str]) -> DataFrame:
    """``score_*`` columns -> (metric, value) rows; metric without prefix."""
    cols = score_columns(df)
    long = df.select(*id_cols, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        id_cols, cols, "metric", "value")
    return long.withColumn("metric", F.regexp_replace("metric", "^score_", ""))


SPLITTERS = [i / 256 for i in range(1, 256)]


def exact_medians(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, median) of ``value``, NULLs skipped, without gathering a key's values:
    equal values are counted first, the counts are dealt to ranges between
    approximate percentiles (which only set the borders), and ranks are taken
    inside the one or two ranges that hold the middle."""
    counts = long.filter(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("c"))
    borders = counts.groupBy(*keys).agg(F.percentile_approx("value", SPLITTERS, 2000).alias("cuts"), F.sum("c").alias("n"))
    dealt = counts.join(borders, keys).withColumn("part", F.size(F.filter("cuts", lambda x: x < F.col("value"))))
    parts = dealt.groupBy(*keys, "part").agg(F.sum("c").alias("held"), F.first("n").alias("n"))
    before = F.sum("held").over(Window.partitionBy(*keys).orderBy("part")) - F.col("held")
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    middle = (parts.withColumn("before", before).filter((F.col("before") < high) & (F.col("before") + F.col("held") >= low))
              .select(*keys, "part", "before"))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "part").orderBy("value"))
    ranked = dealt.join(middle, [*keys, "part"]).withColumn("upto", upto)
    hits = sum(F.when((F.col("upto") >= r) & (F.col("upto") - F.col("c") < r), 1).otherwise(0) for r in (low, high))
    return (ranked.withColumn("hits", hits).filter("hits > 0").groupBy(*keys)
            .agg((F.sum(F.col("value") * F.col("hits")) / 2).alias("median")))


def metric_summary(df: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """O-82: per score column: mean, sample std, min, max, exact median (NULLs
    skipped); ``num_samples`` counts every row of the group (``unpivot``
    keeps NULL values, so each input row yields one row per metric)."""
    keys = [*(group_cols or []), "metric"]
    long = long_scores(df, group_cols or [])
    figures = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return figures.join(exact_medians(long, keys), keys, "left").select(*figures.columns, "median")


def model_comparison(df: DataFrame, model_col: str = "model") -> DataFrame:
    """O-83: one row per model: num_samples, ``<m>_mean`` and ``<m>_std``."""
    aggs = [F.count(F.lit(1)).alias("num_samples")]
    for c in score_columns(df):
        m = c[len("score_"):]
        aggs += [F.avg(c).alias(f"{m}_mean"), F.stddev_samp(c).alias(f"{m}_std")]
    return df.groupBy(model_col).agg(*aggs)


def rows_with_any_metric(df: DataFrame, metrics: list[str]) -> DataFrame:
    """O-85: keep rows with at least one non-NULL metric of ``metrics``
    (those present in the frame); a frame with none of them yields no rows."""
    cols = [f"score_{m}" for m in metrics if f"score_{m}" in df.columns]
    if not cols:
        return df.limit(0)
    return df.filter(F.coalesce(*[F.col(c) for c in cols]).isNotNull())


def model_means(df: DataFrame, model_col: str = "model") -> DataFrame:
    """(model, metric, mean) with NULLs skipped."""
    return long_scores(df, [model_col]).groupBy(model_col, "metric").agg(F.avg("value").alias("mean"))


def order_models(df: DataFrame) -> DataFrame:
    """O-90: models earliest run first (then by name)."""
    return df.orderBy("run_ts", "model")


def normalised_metrics(means: DataFrame) -> DataFrame:
    """O-86: 1-5 scores -> (v-1)/4; levenshtein_distance -> v / largest model
    mean (0 when that is not positive); other metrics unchanged."""
    w = Window.partitionBy("metric")  # rows per metric = number of models
    mx = F.max("mean").over(w)
    v = (F.when(F.col("metric").isin(*ONE_TO_FIVE_METRICS), (F.col("mean") - 1.0) / 4.0)
         .when(F.col("metric") == "levenshtein_distance", F.when(mx > 0, F.col("mean") / mx).otherwise(F.lit(0.0)))
         .otherwise(F.col("mean")))
    return means.withColumn("normalised", v)


def metric_dim(spark, positive: list[str], negative: list[str]) -> DataFrame:
    """O-87: ordered metric list with a lower-is-better flag."""
    rows = [(m, "higher", i) for i, m in enumerate(positive)] + \
           [(m, "lower", len(positive) + i) for i, m in enumerate(negative)]
    return spark.createDataFrame(rows, "metric string, direction string, ord int")


def metric_direction_report(means: DataFrame, dim: DataFrame) -> DataFrame:
    """O-87/O-89: per model the metrics in their fixed order with direction
    (a metric-sized dimension, broadcast)."""
    return means.join(bounded_broadcast(dim), "metric").select("model", "metric", "direction", "ord", "mean")


def chart_feed(means: DataFrame, dim: DataFrame) -> DataFrame:
    """O-86/O-89: what a comparison chart of the models shows: per model the metrics of ``dim``
    in their fixed order, with direction, mean and the normalised value."""
    return (normalised_metrics(means).join(bounded_broadcast(dim), "metric")
            .select("model", "metric", "direction", "ord", "mean", "normalised"))


def model_positions(df: DataFrame) -> DataFrame:
    """O-90 as a column: each (run_ts, model) with its place, from 0, in ``order_models``."""
    runs = df.select("run_ts", "model").distinct()               # a row per run and model
    return runs.withColumn("position", F.row_number().over(Window.orderBy("run_ts", "model")) - 1)


def negative_axis_max(means: DataFrame, negative: list[str]) -> DataFrame:
    """O-88: axis bound for lower-is-better metrics: x = largest model mean;
    0 -> 0.1; below 0.1 round 1.1x up on a 0.02 grid, else on a 0.05 grid."""
    x = means.filter(F.col("metric").isin(*negative)).agg(F.max("mean").alias("x"))
    step = F.when(F.col("x") < 0.1, F.lit(0.02)).otherwise(F.lit(0.05))
    bound = F.when(F.coalesce(F.col("x"), F.lit(0.0)) == 0, F.lit(0.1)).otherwise(
        (F.floor(F.col("x") * 1.1 / step) + 1) * step)
    return x.select(F.col("x").alias("max_negative_mean"), bound.alias("axis_max"))
