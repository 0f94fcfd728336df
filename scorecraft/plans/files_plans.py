"""Plans that write a run's files and read them back (O-06, O-07, O-09, O-10, O-91..O-96):
what a later step sees is what the folders hold.  Each writes into a new folder of the
shared folder (``session.shared_folder``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorecraft import sinks
from scorecraft.operators import analysis as A
from scorecraft.operators import exchange as X
from scorecraft.operators import label_metrics as L
from scorecraft.operators import parsing as P
from scorecraft.operators import records as R
from scorecraft.operators import results as S
from scorecraft.plans import analysis_plans, label_plans, parse_plans, records_plans, results_plans
from scorecraft.plans.fixtures import fixture, fixture_sql
from scorecraft.plans.registry import register, round_doubles, rounded_sql, sql_of
from scorecraft.session import shared_folder
from scorecraft.sources.runs import load_inference_outputs, load_results, scan_newest_runs

# Runs of F-E; their files differ in columns: m1 has no similarity and counts distances in
# whole numbers, the first run of m0 is older and must not be read.
_RUNS = [("2026-01-01_00-00-00", "m0"), ("2026-01-02_00-00-00", "m0"), ("2026-01-01_00-00-00", "m1")]


def write_runs(spark, sf_dir, root):
    scores = fixture(spark, sf_dir, "run_scores")
    for run_ts, model in _RUNS:
        rows = scores.filter((F.col("run_ts") == run_ts) & (F.col("model") == model)).drop("run_ts", "model")
        if model == "m1":
            rows = rows.drop("score_content_similarity").withColumn(
                "score_levenshtein_distance", F.col("score_levenshtein_distance").cast("int"))
        sinks.write_per_item_results(rows, root, run_ts, model, "tool_calling")


@register("run_folders_newest", oracle="WITH e AS (" + fixture_sql("run_scores") + """)
SELECT run_ts, model, 'tool_calling' AS benchmark, record_id, score_exact_match, score_variable_correct_rate, score_tool_hallucination_rate,
       CASE WHEN model = 'm0' THEN score_content_similarity END AS score_content_similarity, score_levenshtein_distance
FROM e WHERE (model, run_ts) IN (SELECT model, max(run_ts) FROM e GROUP BY model)""")
def run_folders_newest(spark, sf_dir):
    """O-07, O-09, O-10: per-item rows of each model's latest run, from run folders whose
    files differ in columns and types."""
    root = shared_folder(spark, "runs")
    write_runs(spark, sf_dir, root)
    return scan_newest_runs(spark, root, "tool_calling")


@register("saved_inference_outputs", oracle=records_plans._w("""
SELECT r.record_id, r.gt_text, CASE WHEN kind = 0 THEN 'tool' WHEN kind = 1 THEN 'error' ELSE 'nlp' END AS answer,
       CASE WHEN kind > 1 THEN concat('answer ', coalesce(r.gt_text, 'none')) END AS content
FROM (SELECT record_id, gt_content AS gt_text, (((conv_id + trigger_turn) % 7) + 7) % 7 AS kind FROM recs) r"""))
def saved_inference_outputs(spark, sf_dir):
    """O-06, O-91: records and answers of one inference run, written by category and read
    back, joined by key."""
    run = shared_folder(spark, "inference")
    records = R.prediction_records(records_plans.turns(spark, sf_dir))
    outputs = results_plans.answers(spark, sf_dir, records)
    sinks.write_partitioned(records, f"{run}/records", ["category"])
    sinks.write_partitioned(outputs.join(records.select("record_id", "category"), "record_id"), f"{run}/responses", ["category"])
    saved, answered, _ = load_inference_outputs(spark, run, guardrail=False)
    kind = F.when(F.size("tool_calls") > 0, "tool").when(F.col("error").isNotNull(), "error").otherwise("nlp")
    return (saved.select("record_id", F.col("gt_content").alias("gt_text"))
            .join(answered.select("record_id", kind.alias("answer"), "content"), "record_id"))


@register("label_prediction_lines", oracle=label_plans._BASE + """
SELECT sample_id, prompt, prompt_label, violated_categories, output, predicted_label FROM v""")
def label_prediction_lines(spark, sf_dir):
    """O-92: label predictions as JSON Lines and back, whole prompts included."""
    path = shared_folder(spark, "predictions")
    valid, _ = L.split_valid(label_plans.rows(spark, sf_dir))
    lines = S.label_predictions(valid, include_prompts=False)
    sinks.write_jsonl(lines, path)
    back = spark.read.schema(lines.schema).json(path)
    return back.select("sample_id", "input.prompt", "input.prompt_label", "input.violated_categories", "output",
                       F.col("parsed_output.output").alias("predicted_label"))


@register("discarded_and_subset_lines", oracle=label_plans._BASE + """
, picked AS (""" + sql_of("balanced_subset") + """)
SELECT 'discarded' AS file, sample_id, prompt_label, output FROM t WHERE NOT is_valid
UNION ALL SELECT 'subset', sample_id, prompt_label, output FROM g JOIN picked USING (sample_id, prompt_label)""")
def discarded_and_subset_lines(spark, sf_dir):
    """O-94, O-95: the rows a label run discards and its balanced subset, as files and back."""
    folder = shared_folder(spark, "label-files")
    rows = label_plans.rows(spark, sf_dir)
    columns = ["sample_id", "prompt_label", "output"]
    _, discarded = L.split_valid(rows)
    sinks.write_jsonl(discarded.select(*columns), f"{folder}/discarded")
    sinks.write_jsonl(L.balanced_subset(rows, "prompt_label", "sample_id", n=100, seed=123).select(*columns), f"{folder}/subset")
    back = [spark.read.schema(rows.select(*columns).schema).json(f"{folder}/{name}").select(F.lit(name).alias("file"), *columns)
            for name in ("discarded", "subset")]
    return back[0].unionByName(back[1])


@register("comparison_table_file", oracle=sql_of("model_comparison"))
def comparison_table_file(spark, sf_dir):
    """O-96, O-07: the model comparison as one CSV file, read back with its schema."""
    path = shared_folder(spark, "comparison")
    table = analysis_plans.model_comparison(spark, sf_dir)
    sinks.write_summary(table, path, "csv")
    return load_results(spark, path, table.schema)


_DIM = " UNION ALL ".join(
    [f"SELECT '{m}' AS metric, 'higher' AS direction, {i} AS ord" for i, m in enumerate(analysis_plans.POSITIVE)]
    + [f"SELECT '{m}', 'lower', {len(analysis_plans.POSITIVE) + i}" for i, m in enumerate(analysis_plans.NEGATIVE)])


@register("content_chart_feed", oracle=rounded_sql(analysis_plans._BASE + analysis_plans._MEANS + f"""
, dim AS ({_DIM})
SELECT model, metric, direction, ord, mean,
       CASE WHEN metric = 'content_similarity' THEN (mean - 1.0) / 4.0
            WHEN metric = 'levenshtein_distance' THEN
                 CASE WHEN max(mean) OVER (PARTITION BY metric) > 0 THEN mean / max(mean) OVER (PARTITION BY metric) ELSE 0.0 END
            ELSE mean END AS normalised
FROM means JOIN dim USING (metric)""", ["model", "metric", "direction", "ord", "mean", "normalised"], {"mean", "normalised"}))
def content_chart_feed(spark, sf_dir):
    means = A.model_means(analysis_plans.latest(spark, sf_dir).drop("run_ts", "record_id"))
    return round_doubles(A.chart_feed(means, A.metric_dim(spark, analysis_plans.POSITIVE, analysis_plans.NEGATIVE)))


@register("model_positions", oracle="WITH e AS (" + fixture_sql("run_scores") + """)
SELECT run_ts, model, CAST(row_number() OVER (ORDER BY run_ts, model) - 1 AS INTEGER) AS position
FROM (SELECT DISTINCT run_ts, model FROM e)""")
def model_positions(spark, sf_dir):
    return A.model_positions(fixture(spark, sf_dir, "run_scores"))


_BAD = 3


@register("parse_failures", oracle=parse_plans._G + f"""
, bad AS (SELECT CASE WHEN record_id % 2 = 0 THEN 'even' ELSE 'odd' END AS half, 'error' AS parse_strategy, record_id, 'timeout' AS pred_error,
                 '' AS raw_text, row_number() OVER (PARTITION BY record_id % 2 ORDER BY md5(concat(cast(record_id AS VARCHAR), '|0')), record_id) AS rank
          FROM x WHERE r = 8)
SELECT half, parse_strategy, record_id, pred_error, raw_text, CAST(rank AS INTEGER) AS rank FROM bad WHERE rank <= {_BAD}""")
def parse_failures(spark, sf_dir):
    """O-46: per half of the records the first bad answers to look at (a top-k report)."""
    parsed = P.parse_outputs(parse_plans.text_responses(spark, sf_dir), "json")
    half = F.when(F.col("record_id") % 2 == 0, "even").otherwise("odd")
    return P.parse_failures(parsed.withColumn("half", half), ["half"], _BAD)


@register("text_ground_truth", oracle=records_plans._w("""
SELECT record_id, gt_role, gt_content FROM recs WHERE gt_content IS NOT NULL"""))
def text_ground_truth(spark, sf_dir):
    """O-50: the population of the content benchmark."""
    records = R.prediction_records(records_plans.turns(spark, sf_dir))
    return R.text_ground_truth(records).select("record_id", "gt_role", "gt_content")


@register("label_output_texts", oracle="WITH g AS (" + fixture_sql("guardrail") + """)
SELECT sample_id, CASE WHEN sample_id % 3 = 0 THEN 'timeout' ELSE regexp_replace(output, '^\\s+|\\s+$', '', 'g') END AS text FROM g""")
def label_output_texts(spark, sf_dir):
    """O-29: the text that a label answer is read from; a third of the answers failed."""
    g = fixture(spark, sf_dir, "guardrail")
    failed = F.col("sample_id") % 3 == 0
    text = L.output_text(F.when(~failed, F.col("output")), F.when(failed, F.lit(" timeout ")))
    return g.select("sample_id", text.alias("text"))


@register("label_requests", oracle="WITH g AS (" + fixture_sql("guardrail") + f""")
SELECT cast(sample_id AS VARCHAR) AS record_id, 'judge' AS model, '["safe","unsafe"]' AS labels, CAST(NULL AS VARCHAR) AS tools,
       '{label_plans.GUARD_SYSTEM}' AS system_content, prompt AS user_content FROM g""")
def label_requests(spark, sf_dir):
    """O-24: request lines whose answer must be one of the labels; no tools beside that."""
    rows = fixture(spark, sf_dir, "guardrail").withColumn("record_id", F.col("sample_id").cast("string"))
    lines = X.structured_requests(L.guardrail_contexts(rows, label_plans.GUARD_SYSTEM), "judge", ["safe", "unsafe"])
    member = lambda path: F.get_json_object("request", path)
    return lines.select(
        member("$.custom_id").alias("record_id"), member("$.body.model").alias("model"),
        member("$.body.response_format.json_schema.schema.properties.classification.enum").alias("labels"),
        member("$.body.tools").alias("tools"), member("$.body.messages[0].content").alias("system_content"),
        member("$.body.messages[1].content").alias("user_content"))
