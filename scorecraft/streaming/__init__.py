"""Streaming.

The evaluation flow is a finite batch end to end (requests are written, a
batch of responses comes back, scores are aggregated); the source system has
no stream, watermark or stateful operator, so none is built here.  Response
files that arrive over time can be scored incrementally by pointing a
``readStream`` file source at them and calling the batch operators from
``foreachBatch``; :func:`score_new_responses` is that glue.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def score_new_responses(stream: DataFrame, score_batch: Callable[[DataFrame], DataFrame],
                        sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``score_batch`` on each micro-batch of ``stream`` and hand the
    result to ``sink(df, epoch_id)``; progress is kept in ``checkpoint`` (a
    shared folder) so a restarted query resumes where it stopped."""
    return (stream.writeStream
            .foreachBatch(lambda df, epoch: sink(score_batch(df), epoch))
            .option("checkpointLocation", checkpoint)
            .start())
