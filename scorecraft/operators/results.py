"""Per-item rows and predictions (O-92, O-93): what a run leaves behind for
analysis, one row per record, joined by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def turn_indices(trigger_turn: Column) -> Column:
    """O-15: positions of the turns in a record's context."""
    return F.sequence(F.lit(0).cast("bigint"), trigger_turn.cast("bigint"))


def _tools_json(tools: Column) -> Column:
    """Calls as a JSON array; none is an empty array."""
    return F.to_json(F.coalesce(tools, F.array().cast("array<struct<name:string,arguments:string>>")))


def tool_item_rows(records: DataFrame, parsed: DataFrame, scores: DataFrame | None = None,
                   raw: DataFrame | None = None) -> DataFrame:
    """O-93, tool and text form.  ``records`` are prediction records, ``parsed`` the
    parse stage's rows; ``scores`` (record_id, score_*) and ``raw`` (record_id and
    the output columns, kept as one JSON text) are optional."""
    tool = F.col("gt_tool_calls").isNotNull()
    rows = records.select(
        "record_id", "uid", "category", F.to_json(turn_indices(F.col("trigger_turn"))).alias("turn_indices"), "gt_turn_index",
        F.when(tool, "tool").otherwise("nlp").alias("gt_type"), F.coalesce("gt_role", F.lit("")).alias("gt_role"),
        F.when(tool, F.col("gt_tool_calls")).otherwise(F.coalesce("gt_content", F.lit(""))).alias("gt_value"))
    predictions = parsed.select("record_id", "pred_type", _tools_json(F.col("pred_tools")).alias("pred_tools"),
                                F.coalesce("pred_response", F.lit("")).alias("pred_response"),
                                F.coalesce("pred_error", F.lit("")).alias("pred_error"))
    out = rows.join(predictions, "record_id")
    if scores is not None:
        out = out.join(scores.select("record_id", *[c for c in scores.columns if c.startswith("score_")]), "record_id", "left")
    if raw is not None:
        whole = F.to_json(F.struct(*[c for c in raw.columns if c != "record_id"]))
        out = out.join(raw.select("record_id", whole.alias("raw_output")), "record_id", "left")
    return out


def label_item_rows(rows: DataFrame, include_raw: bool = True) -> DataFrame:
    """O-93, label form: ``rows`` are guardrail rows (sample_id, prompt, prompt_label,
    violated_categories, output) with ``predicted_label``."""
    same = F.lower("prompt_label") == F.lower(F.coalesce("predicted_label", F.lit("")))
    return rows.select("sample_id", "prompt", F.col("prompt_label").alias("ground_truth_label"),
                       F.coalesce("predicted_label", F.lit("")).alias("predicted_label"),
                       F.coalesce("violated_categories", F.lit("")).alias("violated_categories"),
                       F.coalesce(same, F.lit(False)).alias("correct"),
                       *([F.col("output").alias("raw_output")] if include_raw else []))


def tool_predictions(records: DataFrame, contexts: DataFrame, outputs: DataFrame, parsed: DataFrame,
                     scores: DataFrame | None = None) -> DataFrame:
    """O-92, tool and text form: one nested row per record, for JSON Lines; scores
    where given."""
    truth = records.select("record_id", "uid", "category", turn_indices(F.col("trigger_turn")).alias("turn_indices"), "gt_turn_index",
                           F.struct(F.col("gt_role").alias("role"), F.col("gt_content").alias("content"),
                                    F.col("gt_tool_calls").alias("tool_calls")).alias("ground_truth"))
    output = outputs.select("record_id", F.struct(*[c for c in outputs.columns if c != "record_id"]).alias("output"))
    prediction = parsed.select("record_id", F.struct(
        F.col("pred_type").alias("type"), F.col("pred_tools").alias("tools"), F.col("pred_response").alias("response"),
        F.col("pred_error").alias("error")).alias("parsed_output"))
    out = (truth.join(contexts.select("record_id", "context"), "record_id", "left").join(output, "record_id", "left")
           .join(prediction, "record_id"))
    if scores is not None:
        names = [c for c in scores.columns if c.startswith("score_")]
        out = out.join(scores.select("record_id", F.struct(*[F.col(c).alias(c[len("score_"):]) for c in names]).alias("scores")),
                       "record_id", "left")
    return out


def label_predictions(rows: DataFrame, include_prompts: bool = True) -> DataFrame:
    """O-92, label form: one nested row per sample; the prompt on request."""
    return rows.select("sample_id", F.struct("prompt", "prompt_label", "violated_categories").alias("input"),
                       "output", F.struct(F.col("predicted_label").alias("output")).alias("parsed_output"),
                       *(["prompt"] if include_prompts else []))
