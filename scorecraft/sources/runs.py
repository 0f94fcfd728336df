"""Run outputs (O-06, O-07, O-09, O-10).

Per-item results live at ``<root>/<run_ts>/<model>/<benchmark>/per_item_results.parquet``.
A catalogue of the runs is made from a listing of those folders and one file's footer
per run; which runs are read is decided on it, so no score is scanned to learn what the paths
say.  All chosen runs and models are one frame, tagged ``run_ts``, ``model`` and
``benchmark`` from each row's file path (``_metadata.file_path``).
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorecraft.functions.partitioning import bounded_broadcast

BENCHMARKS = ("tool_calling", "guardrailing", "content")
RESULTS_FILE = "per_item_results.parquet"


def detect_benchmark(path: Column) -> Column:
    """O-10: the first benchmark name contained in the lower-cased path."""
    p = F.lower(path)
    out = F.lit(None).cast("string")
    for b in reversed(BENCHMARKS):
        out = F.when(p.contains(b), F.lit(b)).otherwise(out)
    return out


def load_results(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """O-07: Parquet when the path ends in ``.parquet``, else CSV with header."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def load_inference_outputs(spark: SparkSession, run_dir: str, guardrail: bool = True):
    """O-06: the saved ``records`` and ``responses`` tables of one inference
    run (Parquet directories), and the guardrail outputs when present; a
    missing guardrail table is skipped with a warning (None)."""
    import logging

    from pyspark.errors import AnalysisException
    base = run_dir.rstrip("/")
    records = spark.read.parquet(f"{base}/records")
    responses = spark.read.parquet(f"{base}/responses")
    guard = None
    if guardrail:
        try:
            guard = spark.read.parquet(f"{base}/guardrail_outputs")
        except AnalysisException:
            logging.getLogger(__name__).warning("no guardrail outputs under %s; skipping", base)
    return records, responses, guard


CATALOGUE = "run_ts string, model string, benchmark string, path string, schema string"


def _tags(path: Column, benchmark: str) -> list[Column]:
    rx = r"^(.*/([^/]+)/([^/]+)/" + benchmark + "/" + RESULTS_FILE.replace(".", r"\.") + ")"
    return [F.regexp_extract(path, rx, 2).alias("run_ts"), F.regexp_extract(path, rx, 3).alias("model"),
            detect_benchmark(path).alias("benchmark"), F.regexp_extract(path, rx, 1).alias("path")]


def run_catalogue(spark: SparkSession, root: str, benchmark: str, known: DataFrame | None = None) -> DataFrame:
    """O-09: a row per run and model of one benchmark: run_ts, model, benchmark, path and the
    schema of its results as JSON.  The rows come from a listing of the folders; no file's
    content is read but one footer of each run.  Runs in ``known`` (an earlier catalogue) keep
    its schema and are not opened again."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
             .load(f"{root.rstrip('/')}/*/*/{benchmark}/{RESULTS_FILE}"))
    found = files.select(*_tags(F.col("path"), benchmark)).distinct()
    old = {r.path: r.schema for r in known.collect()} if known is not None else {}
    # As many rows as runs and models: their paths have to be named to a reader anyway.
    rows = [(*r, old.get(r.path) or spark.read.parquet(r.path).schema.json())
            for r in found.orderBy("path").collect()]
    return spark.createDataFrame(rows, CATALOGUE)


def newest_runs(catalogue: DataFrame) -> DataFrame:
    """The catalogue's latest run of each model and benchmark."""
    newest = F.max_by(F.struct(*catalogue.columns), F.struct("run_ts", "path"))
    return catalogue.groupBy("model", "benchmark").agg(newest.alias("r")).select("r.*")


_WHOLE = ("tinyint", "smallint", "int", "bigint")
_BROKEN = ("float", "double")


def wider_type(column: str, a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: the wider whole number, double for whole and broken numbers
    (whole numbers beyond 2**53 lose digits), any type for an untyped column.  Others that
    differ raise."""
    x, y = a.simpleString(), b.simpleString()
    if x == y or y == "void":
        return a
    if x == "void":
        return b
    if x in _WHOLE and y in _WHOLE:
        return a if _WHOLE.index(x) > _WHOLE.index(y) else b
    if x in _WHOLE + _BROKEN and y in _WHOLE + _BROKEN:
        return T.DoubleType()
    raise ValueError(f"runs differ in column {column!r}: {x} and {y}")


def union_schema(schemas: list[T.StructType]) -> T.StructType:
    """All columns of ``schemas`` in the order they are first met, each with a type that holds
    its values of every schema."""
    types: dict[str, T.DataType] = {}
    for field in (f for s in schemas for f in s.fields):
        types[field.name] = wider_type(field.name, types[field.name], field.dataType) if field.name in types else field.dataType
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


def read_runs(spark: SparkSession, catalogue: DataFrame) -> DataFrame:
    """O-07/O-09: the per-item rows of the catalogue's runs and of no other: run_ts, model,
    benchmark, then every column that any of them has.  A run without a column has NULL there,
    and a column's type holds the values of all runs.  Runs of equal schema are one scan.
    An empty catalogue gives no rows and no score columns."""
    alike: dict[str, list] = {}
    for run in catalogue.orderBy("path").collect():              # a row per run and model
        alike.setdefault(run.schema, []).append(run)
    if not alike:
        return spark.createDataFrame([], "run_ts string, model string, benchmark string")
    own = {text: T.StructType.fromJson(json.loads(text)) for text in alike}
    whole = union_schema(list(own.values()))
    parts = []
    for text, runs in alike.items():
        names = set(own[text].fieldNames())
        columns = [(F.col(f"`{f.name}`") if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in whole]
        for benchmark in sorted({r.benchmark for r in runs}):
            rows = spark.read.schema(own[text]).parquet(*[r.path for r in runs if r.benchmark == benchmark])
            parts.append(rows.select(*_tags(F.col("_metadata.file_path"), benchmark)[:3], *columns))
    return reduce(DataFrame.unionByName, parts)


def scan_runs(spark: SparkSession, root: str, benchmark: str) -> DataFrame:
    """O-09: every run and model of one benchmark, tagged from the path."""
    return read_runs(spark, run_catalogue(spark, root, benchmark))


def scan_newest_runs(spark: SparkSession, root: str, benchmark: str, known: DataFrame | None = None) -> DataFrame:
    """O-09: the latest run of each model; files of earlier runs are listed, not read."""
    return read_runs(spark, newest_runs(run_catalogue(spark, root, benchmark, known)))


def latest_run_per_model(df: DataFrame, include_timestamp: bool = False) -> DataFrame:
    """Explicit policy for a model present in several runs: keep its latest
    run (the reference keeps whichever directory it happened to read last).
    With ``include_timestamp`` every run stays, keyed ``<run_ts>_<model>``."""
    if include_timestamp:
        return df.withColumn("model", F.concat_ws("_", "run_ts", "model"))
    # Where the rows lie in run folders, ``scan_newest_runs`` reads only the files that stay.
    latest = df.groupBy("model").agg(F.max("run_ts").alias("run_ts"))
    return df.join(bounded_broadcast(latest), ["model", "run_ts"], "left_semi")
