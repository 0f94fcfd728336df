"""Joins on keys of which a few may hold most rows.

A key with more than 1/``HOT`` of all rows is joined by broadcast; there are fewer than
``HOT`` such keys, so what is broadcast is bounded by that.  All other keys hold at most that
share each and are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 10_000


def join_counted(rows: DataFrame, counts: DataFrame, keys: list[str], total: int, n: str = "n") -> DataFrame:
    """``rows`` joined with ``counts``, which has at most one row per key and, in ``n``, the
    number of ``total`` rows with it (the column is dropped)."""
    often = F.col(n) * HOT > total
    hot, rest = F.broadcast(counts.filter(often).drop(n)), counts.filter(~often).drop(n)
    few = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(few.join(rest, keys))
