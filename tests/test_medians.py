"""Exact medians that are computed by ranges."""

import random
import statistics

from scorecraft.operators.analysis import exact_medians


def test_medians_by_hand(spark):
    random.seed(3)
    rows = [("a", random.random()) for _ in range(1001)] + [("b", float(random.randint(0, 3))) for _ in range(500)]
    rows += [("c", 1.0), ("c", 2.0), ("d", None), ("e", 7.5)] + [("f", float(i)) for i in range(2000)] + [("a", None)]
    df = spark.createDataFrame(rows, "metric string, value double")
    got = {r.metric: r.median for r in exact_medians(df, ["metric"]).collect()}
    want: dict = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    assert got == {k: statistics.median(v) for k, v in want.items()}
