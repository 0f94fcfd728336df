"""Writers (O-91..O-96).  All writes are Spark jobs to the target path; the
per-item layout ``<root>/<run_ts>/<model>/<benchmark>/per_item_results.parquet``
is what :func:`scorecraft.sources.runs.scan_runs` reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.sources.runs import RESULTS_FILE


def results_path(root: str, run_ts: str, model: str, benchmark: str) -> str:
    return f"{root.rstrip('/')}/{run_ts}/{model}/{benchmark}/{RESULTS_FILE}"


def write_per_item_results(df: DataFrame, root: str, run_ts: str, model: str, benchmark: str,
                           csv: bool = False) -> str:
    """O-93: per-item results of one run, model and benchmark (Parquet; CSV
    beside it on request, nested columns as JSON text)."""
    path = results_path(root, run_ts, model, benchmark)
    df.write.mode("overwrite").parquet(path)
    if csv:
        flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c)
                           for c, t in df.dtypes])
        flat.write.mode("overwrite").option("header", True).csv(path[: -len(".parquet")] + ".csv")
    return path


def write_partitioned(df: DataFrame, path: str, partition_cols: list[str]) -> None:
    """O-91: records / responses partitioned by run and model; re-running a
    run replaces only its own partitions (dynamic partition overwrite)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).parquet(path))


def write_jsonl(df: DataFrame, path: str) -> None:
    """O-92/O-94/O-95: predictions, discarded rows, balanced subsets."""
    df.write.mode("overwrite").json(path)


def write_summary(df: DataFrame, path: str, fmt: str = "json") -> None:
    """O-96: small aggregate frames (summaries, comparison tables) as one
    file; the frames are metric- or model-sized, so one partition is right."""
    w = df.coalesce(1).write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.json(path)
