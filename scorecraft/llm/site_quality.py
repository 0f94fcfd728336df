"""Quality classifier: document evidence and site posteriors (empirical Bayes).

1. A logistic regression over hashed n-grams and a few shares (upper case,
   symbols, repeated words and lines), trained on a bounded sample of labelled
   documents, gives each document a log-likelihood ratio (its log-odds less
   those of the training prior).
2. Every document adds to its site's count: its label where there is one, else
   its probability under the classifier.  Grouped sums give totals per path
   (host and language section) and per host.
3. The strength of the prior is estimated by the method of moments from the
   spread of the host rates.  Hosts shrink toward the global rate and paths
   toward their host, so sparse sites lean on what stands above them.
4. A document's posterior log-odds are its path's log-odds plus its own ratio,
   without its own share in the site counts.

Null hosts or sections form a site of their own.  A null or empty text carries
no evidence (ratio 0).  With no labels of both kinds every document is kept.
Repeated rows are separate documents.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.llm import linear
from scorecraft.llm.batches import Powers, give_back, slices
from scorecraft.llm.quality_rules import base_signals
from scorecraft.llm.storage import hold

FEATURES = linear.Features(words=(1,), chars=(4,), bits=16, mean=True)
KEEP_AT = 0.5
DENSE = 5.0                    # scale of the dense signals beside the hashed shares
SMALLEST_STRENGTH, LARGEST_STRENGTH = 2.0, 1_000.0


def shares(data, off, powers: Powers):
    """Dense signals per document: shares of upper case and symbols among the
    bytes, of repeated words, of repeated lines among words."""
    s = base_signals(data, off, powers)
    size, n = np.maximum(np.diff(off), 1), np.maximum(s["n_words"], 1)
    upper = np.r_[0, np.cumsum((data >= 0x41) & (data <= 0x5A))]
    return np.c_[(upper[off[1:]] - upper[off[:-1]]) / size, s["n_symbols"] / size,
                 s["n_repeat_words"] / n, np.minimum(s["n_dup_lines"] / n, 1)] * DENSE


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 2_000) -> tuple:
    """(weights, dense weights, a, b, prior): calibrated classifier and its training prior."""
    starts, bucket, value, y, x = linear.featurise(
        linear.sample(docs, labels, max_rows, ["quality"]), FEATURES, ["quality"], shares)
    rows, y = (starts, bucket, value), (y["quality"] > 0).astype(float)
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(FEATURES.size, np.float32), np.zeros(4), 0.0, 0.0, None
    test = np.arange(len(y)) % 4 == 0
    train, check = np.flatnonzero(~test), np.flatnonzero(test)
    model = linear.Logistic(FEATURES.size, extra=4, l2=1e-5, steps=150, scale=20.0)
    model.fit(linear.take(rows, train), y[train], x[train])
    a, b = linear.calibrate(model.decision(linear.take(rows, check), x[check]), y[check])
    return (model.w * model.scale).astype(np.float32), model.v, a, a * model.b + b, float(y.mean())


def document_evidence(docs: DataFrame, model: tuple, host: str, path: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, host, path, p_doc, ratio) per document, with the ``carried`` columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        powers = Powers()
        weights, dense, a, b, prior = shared.value
        for batch in batches:
            for rows, data, off, _ in slices(batch):
                if prior is None:
                    p, ratio = np.ones(len(off) - 1), np.zeros(len(off) - 1)
                else:
                    z = a * (FEATURES.scores(data, off, weights, powers) + shares(data, off, powers) @ dense) + b
                    z = np.where(np.diff(off) > 0, z, np.log(prior / (1 - prior)))
                    p, ratio = linear.sigmoid(z), z - np.log(prior / (1 - prior))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("host"), rows.column("path"), pa.array(p), pa.array(ratio),
                     *[rows.column(c) for c in carried]], ["doc_id", "host", "path", "p_doc", "ratio", *carried])

    sites = docs.select("doc_id", F.to_json(F.struct(F.col(host))).alias("host"),
                        F.to_json(F.struct(F.col(host), F.col(path))).alias("path"), "text", *carried)
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return sites.mapInArrow(run, f"doc_id {kind}, host string, path string, p_doc double, ratio double{more}")


def prior_of(good: float, n: int, k: int, s2: float, n2: float) -> tuple[float, float]:
    """(rate, strength) of the prior by the method of moments: ``s2`` is the sum of
    good^2 / n over the ``k`` hosts, ``n2`` that of n^2."""
    rate = min(max(good / n, 1e-4), 1 - 1e-4) if n else 0.5
    within = rate * (1 - rate)
    spread = (s2 - good ** 2 / n - (k - 1) * within) / max(n - n2 / n, 1.0) if n else 0.0
    strength = within / spread - 1 if spread > 0 else LARGEST_STRENGTH
    return rate, min(max(strength, SMALLEST_STRENGTH), LARGEST_STRENGTH)


def posteriors(evidence: DataFrame, labels: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Evidence rows with the site counts and the posterior of good quality."""
    known = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = (evidence.join(known, "doc_id", "left")
            .withColumn("good", F.coalesce((F.col("quality") > 0).cast("double"), F.col("p_doc"))))
    paths = rows.groupBy("host", "path").agg(F.sum("good").alias("path_good"), F.count("*").alias("path_n"))
    hosts = paths.groupBy("host").agg(F.sum("path_good").alias("host_good"), F.sum("path_n").alias("host_n"))
    # One row of global figures: rate, and the spread of the host rates around it.
    g = hosts.agg(F.sum("host_good").alias("good"), F.sum("host_n").alias("n"), F.count("*").alias("k"),
                  F.sum(F.col("host_good") ** 2 / F.col("host_n")).alias("s2"),
                  F.sum(F.col("host_n").cast("double") ** 2).alias("n2")).first()
    rate, strength = prior_of(g.good or 0.0, g.n or 0, g.k, g.s2 or 0.0, g.n2 or 0.0)
    sites = paths.join(hosts, "host")
    out = rows.join(sites, ["host", "path"])
    own = F.col("good")
    host_rate = (F.col("host_good") - own + strength * rate) / (F.col("host_n") - 1 + strength)
    path_rate = ((F.col("path_good") - own + strength * host_rate) / (F.col("path_n") - 1 + strength))
    sure = F.least(F.greatest(path_rate, F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = F.log(sure / (1 - sure)) + F.col("ratio")
    return (out.withColumn("site_rate", path_rate).withColumn("posterior", 1 / (1 + F.exp(-logit)))
            .select("doc_id", "p_doc", "host_n", "path_n", "site_rate", "posterior", *carried))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang",
             max_rows: int = 2_000, keep_at: float = KEEP_AT, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, p_doc, host_n, path_n, site_rate, posterior, kept) per document, with the
    ``carried`` columns."""
    model = fit(docs, labels, max_rows)
    give_back()                                              # the training's arrays, which the driver would keep
    out = posteriors(hold(document_evidence(docs, model, host, path, carried)), labels, carried)
    return out.withColumn("kept", F.col("posterior") >= keep_at)
