"""Partitioning helpers for CPU-heavy stages.

``repartition(col)`` without a count lets AQE coalesce small shuffles into a
few partitions -- right for cheap rows, wrong before a Python UDF or VARIANT
flattening where a partition of a few MB is already seconds of CPU.  An
explicit count (the session's ``spark.sql.shuffle.partitions``, sized by the
cluster operator for the data) is kept as is by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_key(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition on ``cols`` into the session's shuffle partition count."""
    return df.repartition(shuffle_partitions(df), *cols)


def bounded_broadcast(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """A broadcast hint for a dimension that has at most ``most_rows`` rows, which is
    counted first (no further than the bound); a larger one is joined as Spark
    sees fit."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
