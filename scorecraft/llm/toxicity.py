"""Toxicity by classifier chains.

The categories are predicted in a fixed order.  Each is a sparse linear model
over hashed words (present or not), and every model after the
first also reads the log-odds that the earlier categories received.  For the
training rows those come from models trained without the row's fold
(out-of-fold), so a later model sees earlier predictions as uncertain as they
will be on new documents.  An l1 penalty leaves weight only on telling words,
so long texts do not gather noise.

The models are fitted on a bounded sample (``max_rows``) of labelled rows and
predict every whole text.  Null and empty texts get the intercepts alone;
repeated rows get equal results; a category with one kind of label is
predicted by its share.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.llm import linear
from scorecraft.llm.batches import ALNUM, Powers, slices

FEATURES = linear.Features(words=(1,), bits=20, mean=False, member=ALNUM, lower=True)
FOLDS = 3
L1 = 1e-2
THRESHOLD = 0.35


def _model(rows, y, x):
    share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
    model = linear.Logistic(FEATURES.size, extra=x.shape[1], l1=L1, steps=80, rare=True)
    if len(y) == 0 or y.min() == y.max():
        model.b = float(np.log(share / (1 - share)))
        return model
    positive = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))      # both kinds weigh the same
    model.fit(rows, y, x, positive)
    return model


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], max_rows: int = 8_000) -> list[dict]:
    """One dictionary (weights, chain weights, bias, a, b) per category, in order."""
    starts, bucket, value, y, _ = linear.featurise(
        linear.sample(docs, labels, max_rows, categories), FEATURES, categories)
    rows, n = (starts, bucket, value), len(starts) - 1
    fold = np.arange(n) % FOLDS
    chain, earlier = [], np.zeros((n, 0))
    for c in categories:
        target = (y[c] > 0).astype(float) if n else np.zeros(0)
        out_of_fold = np.zeros(n)
        for f in range(FOLDS if n >= 2 * FOLDS else 0):
            inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            m = _model(linear.take(rows, inside), target[inside], earlier[inside])
            out_of_fold[outside] = m.decision(linear.take(rows, outside), earlier[outside])
        a, b = linear.calibrate(out_of_fold, target) if n >= 2 * FOLDS else (1.0, 0.0)
        m = _model(rows, target, earlier)
        used = np.flatnonzero(m.w)
        chain.append({"category": c, "at": used, "w": m.w[used], "v": m.v, "bias": m.b, "a": a, "b": b})
        earlier = np.c_[earlier, np.clip(a * out_of_fold + b, -8, 8)]
    return chain


def predict(docs: DataFrame, chain: list[dict], threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, p_<category>..., is_<category>...) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [m["category"] for m in chain]

    def run(batches):
        import pyarrow as pa

        powers, models = Powers(), shared.value
        dense = []
        for m in models:
            w = np.zeros(FEATURES.size)
            w[m["at"]] = m["w"]
            dense.append(w)
        for batch in batches:
            for rows, data, off, _ in slices(batch):
                pairs = list(FEATURES.pairs(data, off, powers))
                n = len(off) - 1
                earlier = np.zeros((n, 0))
                for m, w in zip(models, dense):
                    z = sum(np.bincount(d, weights=w[k], minlength=n) for d, k in pairs) + earlier @ m["v"] + m["bias"]
                    earlier = np.c_[earlier, np.clip(m["a"] * z + m["b"], -8, 8)]
                p = linear.sigmoid(earlier)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), *[pa.array(p[:, i]) for i in range(len(names))],
                     *[pa.array(p[:, i] >= threshold) for i in range(len(names))]],
                    ["doc_id", *[f"p_{c}" for c in names], *[f"is_{c}" for c in names]])

    schema = [f"doc_id {kind}", *[f"p_{c} double" for c in names], *[f"is_{c} boolean" for c in names]]
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(schema))


def with_low_quality(labels: DataFrame) -> DataFrame:
    """Labels with the category ``low_quality`` (quality 0) beside ``toxic``."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
