"""O-02: guardrail rows from JSON Lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_FIELDS = ("prompt", "prompt_label", "violated_categories")


def require_fields(df: DataFrame, fields) -> DataFrame:
    """Raise when a required field is missing, else project to ``fields``."""
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise ValueError(f"missing required fields: {missing}")
    return df.select(*fields)


def load_guardrail_rows(spark: SparkSession, path: str, fields=DEFAULT_FIELDS,
                        max_samples: int | None = None) -> DataFrame:
    """JSON Lines projected to ``fields`` (text), optionally the first
    ``max_samples``.  No inference pass: a line that lacks a field raises when
    it is read, naming the field."""
    member = F.from_json("value", "map<string,string>")
    rows = spark.read.text(path).filter(F.trim("value") != "").select(member.alias("m"))
    columns = [F.when(F.coalesce(F.map_contains_key("m", F.lit(f)), F.lit(False)), F.col("m")[f])
               .otherwise(F.raise_error(F.lit(f"missing required field: {f}"))).alias(f) for f in fields]
    df = rows.select(*columns)
    return df.limit(max_samples) if max_samples else df
