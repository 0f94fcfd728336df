"""Quality rules: exact text signals and a calibrated hashed classifier.

Base signals per document: word count, code points in words, symbol
characters, repeated lines and words inside repeated 8-word windows; fixed
limits on them give ``base_failed``.  The verdict on the rest comes from a
logistic regression over hashed word and character n-grams, trained on
labelled quality rows (a bounded sample of ``max_rows``), calibrated by Platt
scaling on a part that training did not see, and compared with a fixed
threshold.

Null and empty texts have no words and so fail the base rule; repeated rows
get equal results; without labels of both kinds the probability is the share
of good rows (1 if there are none).  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from scorecraft.llm import linear
from scorecraft.llm.batches import (SPACED, U64, Powers, byte_class, covered, mix, per_row, runs, slices, windows)

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
KEEP_AT = 0.5                  # smallest calibrated probability of good quality that is kept
SYMBOLS = byte_class(*b"#*$%&|<>")
FEATURES = linear.Features(words=(1, 2), chars=(4,), bits=16, mean=True)


def repeated(doc, h):
    """Indices of items whose (doc, hash) occurs at least twice."""
    key = mix(h ^ (doc.astype(U64) * U64(0xD6E8FEB86659FD93)))
    order = np.argsort(key)
    s = key[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(len(s), bool)
    hit[1:] |= same
    hit[:-1] |= same
    return np.sort(order[hit])


def base_signals(data, off, powers: Powers) -> dict:
    """Exact signals of a slice of documents, one array each."""
    n = len(off) - 1
    start, end, doc = runs(data, off, SPACED)
    prefix = powers.prefix(data)
    words = powers.spans(prefix, start, end)
    lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]          # code points before each byte
    window, first = windows(words, doc, WINDOW, 8)
    hit = covered(first[repeated(doc[first], window)], WINDOW, len(words))
    l_start, l_end, l_doc = runs(data, off, ~byte_class(0x0A))
    worded = np.searchsorted(start, l_end) > np.searchsorted(start, l_start)
    l_start, l_end, l_doc = l_start[worded], l_end[worded], l_doc[worded]
    lines = mix(powers.spans(prefix, l_start, l_end) ^ (l_doc.astype(U64) * U64(0xD6E8FEB86659FD93)))
    first_line = np.unique(lines, return_index=True)[1]
    n_words = per_row(doc, n)
    n_repeat = per_row(doc[hit], n)
    return {"n_words": n_words,
            "word_chars": np.bincount(doc, weights=lead[end] - lead[start], minlength=n).astype(np.int64),
            "n_symbols": per_row(np.searchsorted(off, np.flatnonzero(SYMBOLS[data]), side="right") - 1, n),
            "n_dup_lines": per_row(l_doc, n) - per_row(l_doc[first_line], n),
            "n_repeat_words": n_repeat,
            "base_failed": (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)}


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 2_000) -> tuple:
    """(weights, a, b): hashed weights and the calibration of their score."""
    starts, bucket, value, y, _ = linear.featurise(
        linear.sample(docs, labels, max_rows, ["quality"]), FEATURES, ["quality"])
    rows, y = (starts, bucket, value), (y["quality"] > 0).astype(float)
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(FEATURES.size, np.float32), 0.0, 30.0 if len(y) == 0 else float(30 * (2 * y[0] - 1))
    test = np.arange(len(y)) % 4 == 0
    model = linear.Logistic(FEATURES.size, l2=1e-5, steps=150, scale=20.0)
    train = np.flatnonzero(~test)
    model.fit(linear.take(rows, train), y[train])
    check = np.flatnonzero(test)
    a, b = linear.calibrate(model.decision(linear.take(rows, check), np.zeros((len(check), 0))), y[check])
    return (model.w * model.scale).astype(np.float32), a, a * model.b + b


def apply(docs: DataFrame, model: tuple, keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, base signals, base_failed, p_good, kept) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        powers = Powers()
        weights, a, b = shared.value
        for batch in batches:
            for rows, data, off, _ in slices(batch):
                s = base_signals(data, off, powers)
                p = linear.sigmoid(a * FEATURES.scores(data, off, weights, powers) + b)
                kept = ~s["base_failed"] & (p >= keep_at)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), *[pa.array(s[c]) for c in s], pa.array(p), pa.array(kept)],
                    ["doc_id", *s, "p_good", "kept"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
             "n_repeat_words long, base_failed boolean, p_good double, kept boolean")
