"""Hashed linear models: features from text bytes, training, scoring.

A feature family turns a slice of documents into (document, bucket) pairs; a
document's score is the weighted mean (``mean=True``) or the weighted sum over
distinct buckets (``mean=False``) of its families, plus extra numeric columns.
Training uses a bounded sample of labelled documents (``sample``), proximal
gradient steps with momentum and a logistic loss; scoring runs where the text
is, in Arrow batches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.batches import SPACED, U64, Powers, give_back, lower_ascii, runs, slices, windows


class Features:
    """``words``: word n-gram lengths; ``chars``: byte n-gram lengths; ``bits``:
    log2 of the buckets per family; ``mean``: see the module docstring."""

    def __init__(self, words=(1,), chars=(), bits: int = 16, mean: bool = True, member=SPACED,
                 lower: bool = False):
        self.words, self.chars, self.bits, self.mean = tuple(words), tuple(chars), bits, mean
        self.member, self.lower = member, lower
        self.families = len(self.words) + len(self.chars)
        self.size = self.families << bits

    def pairs(self, data, off, powers: Powers):
        """(document, bucket) of one family after the other."""
        if self.lower:
            data = lower_ascii(data)
        prefix = powers.prefix(data)
        for family, (doc, h) in enumerate(self._families(data, off, prefix, powers)):
            bucket = (h >> U64(64 - self.bits)).astype(np.int32) + np.int32(family << self.bits)
            if not self.mean:
                key = np.sort((doc.astype(np.int64) << 32) | bucket)
                key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
                doc, bucket = key >> 32, (key & 0xFFFFFFFF).astype(np.int32)
            yield doc, bucket

    def _families(self, data, off, prefix, powers: Powers):
        if self.words:
            start, end, doc = runs(data, off, self.member)
            word = powers.spans(prefix, start, end)
            for n in self.words:
                h, at = (word, slice(None)) if n == 1 else windows(word, doc, n, 100 + n)
                yield doc[at], h
        owner = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
        for n in self.chars:
            at = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1:]) if len(owner) >= n else np.zeros(0, np.int64)
            yield owner[at], powers.spans(prefix, at, at + n)

    def scores(self, data, off, weights, powers: Powers):
        n = len(off) - 1
        total = np.zeros(n)
        for doc, bucket in self.pairs(data, off, powers):
            s = np.bincount(doc, weights=weights[bucket], minlength=n)
            total += s / np.maximum(np.bincount(doc, minlength=n), 1) if self.mean else s
        return total


def sample(docs: DataFrame, labels: DataFrame, most: int, columns: list[str], longest: int = 20_000) -> DataFrame:
    """At most ``most`` labelled rows (doc_id, text, *columns): the first by the
    hash of the id among the documents of at most ``longest`` characters; of rows that
    share an id the one with the smallest hash of the text."""
    known = labels.select("doc_id", *columns).dropna().groupBy("doc_id").agg(*[F.max(c).alias(c) for c in columns])
    short = docs.filter(F.col("text").isNotNull() & (F.length("text") <= longest)).select("doc_id", "text")
    ids = (short.select("doc_id").distinct().join(known, "doc_id")
           .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(most))
    return (short.join(F.broadcast(ids), "doc_id").groupBy("doc_id", *columns)
            .agg(F.min_by("text", F.xxhash64("text")).alias("text")))


def featurise(rows: DataFrame, features: Features, columns: list[str], extra=None, least: int = 3) -> tuple:
    """The bounded sample as numpy arrays: (row starts, buckets, values, labels,
    extra), rows ordered by the hash of their id and without the buckets that fewer
    than ``least`` of them hold.  ``extra(bytes, offsets, powers)``
    gives a matrix of further columns."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        powers = Powers()
        for batch in batches:
            for part, data, off, _ in slices(batch):
                n = len(off) - 1
                more = np.zeros((n, 0)) if extra is None else extra(data, off, powers)
                doc, bucket, value = [], [], []
                for d, b in features.pairs(data, off, powers):
                    key, count = np.unique((d.astype(np.int64) << 32) | b, return_counts=True)
                    doc.append(key >> 32)
                    bucket.append(key & 0xFFFFFFFF)
                    total = np.maximum(np.bincount(d, minlength=n), 1)
                    value.append(count / total[key >> 32] if features.mean else np.ones(len(key)))
                doc, bucket, value = map(np.concatenate, (doc, bucket, value))
                order = np.argsort(doc, kind="stable")
                bounds = pa.array(np.r_[0, np.cumsum(np.bincount(doc, minlength=n))].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"),
                     pa.ListArray.from_arrays(bounds, pa.array(bucket[order].astype(np.int32))),
                     pa.ListArray.from_arrays(bounds, pa.array(value[order].astype(np.float32))),
                     pa.array(list(more), pa.list_(pa.float64())),
                     *[part.column(c).cast(pa.float64()) for c in columns]],
                    ["doc_id", "bucket", "value", "extra", *columns])

    out = rows.select("doc_id", "text", *columns).mapInArrow(
        run, f"doc_id {kind}, bucket array<int>, value array<float>, extra array<double>, " + ", ".join(f"{c} double" for c in columns))
    got = out.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").toArrow()      # the bounded sample
    flat = {c: got[c].combine_chunks() for c in ("bucket", "value")}
    starts = np.r_[0, np.cumsum(np.asarray(flat["bucket"].value_lengths(), np.int64))].astype(np.int64)
    more = np.array(got["extra"].to_pylist(), float) if len(got) else np.zeros((0, 0))
    labels = {c: got[c].to_numpy() for c in columns}
    del got
    rows = often((starts, flat["bucket"].flatten().to_numpy(), flat["value"].flatten().to_numpy()), features.size, least)
    del flat
    give_back()                                              # Arrow's part, before training needs its own
    return *rows, labels, more


def often(rows, size: int, least: int):
    """Rows with the buckets alone that at least ``least`` of them hold."""
    starts, bucket, value = rows
    keep = (np.bincount(bucket, minlength=size) >= least)[bucket]
    left = np.r_[0, np.cumsum(keep)]
    return left[starts], bucket[keep], value[keep]


def sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, float)))


class Logistic:
    """Sparse logistic regression with ``extra`` dense columns; weights and bias
    are found by accelerated proximal gradient steps (l1 keeps them sparse)."""

    def __init__(self, size: int, extra: int = 0, l1: float = 0.0, l2: float = 0.0, steps: int = 150,
                 scale: float = 1.0, rare: bool = False):
        self.rare = rare            # weigh buckets by the logarithm of their rarity while training
        self.w, self.v, self.b = np.zeros(size), np.zeros(extra), 0.0
        self.l1, self.l2, self.steps, self.scale = l1, l2, steps, scale

    def decision(self, rows, x):
        starts, bucket, value = rows
        n = len(starts) - 1
        doc = np.repeat(np.arange(n), np.diff(starts))
        return np.bincount(doc, weights=self.w[bucket] * value, minlength=n) * self.scale + x @ self.v + self.b

    def fit(self, rows, y, x=None, weight=None):
        starts, bucket, value = rows
        n = len(y)
        if n == 0:
            return self
        x = np.zeros((n, 0)) if x is None else x
        weight = np.ones(n) / n if weight is None else weight / weight.sum()
        doc, value = np.repeat(np.arange(n), np.diff(starts)), value * self.scale
        rows_of = np.bincount(bucket, minlength=len(self.w))
        used = np.flatnonzero(rows_of)
        place = np.zeros(len(self.w), np.int32)
        place[used] = np.arange(len(used))
        bucket, m = place[bucket], len(used)
        boost = np.log1p(n / rows_of[used]) if self.rare else np.ones(m)
        value = value * boost[bucket]
        self.b = float(np.log((weight @ y + 1e-3) / (weight @ (1 - y) + 1e-3)))
        # A quarter of the weighted row norms bounds the curvature.
        norm = np.bincount(doc, weights=value ** 2, minlength=n) + 1 + (x ** 2).sum(axis=1)
        step = 4.0 / max(float(weight @ norm), 1e-9)
        p = np.r_[np.zeros(m), self.v, self.b]
        q, t = p.copy(), 1.0
        for _ in range(self.steps):
            w, v, b = q[:m], q[m: -1], q[-1]
            r = weight * (sigmoid(np.bincount(doc, weights=w[bucket] * value, minlength=n) + x @ v + b) - y)
            g = np.r_[np.bincount(bucket, weights=r[doc] * value, minlength=m) + self.l2 * w, x.T @ r, r.sum()]
            new = q - step * g
            new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - step * self.l1, 0)
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            q, p, t = new + (t - 1) / t2 * (new - p), new, t2
        self.w[used], self.v, self.b = p[:m] * boost, p[m: -1], float(p[-1])
        return self


def take(rows, keep):
    """The rows named by index array ``keep``."""
    starts, bucket, value = rows
    sizes = np.diff(starts)[keep]
    new = np.r_[0, np.cumsum(sizes)]
    at = np.repeat(starts[:-1][keep] - new[:-1], sizes) + np.arange(new[-1])
    return new, bucket[at], value[at]


def calibrate(z, y, steps: int = 100):
    """Platt scaling (a, b) of decision values by Newton steps on smoothed targets."""
    if len(z) == 0 or y.min() == y.max():
        return 1.0, 0.0
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    spread = z.std() or 1.0
    f = np.c_[z / spread, np.ones(len(z))]
    ab = np.zeros(2)
    for _ in range(steps):
        p = sigmoid(f @ ab)
        h = (f * (p * (1 - p))[:, None]).T @ f + 1e-4 * np.eye(2)
        move = np.linalg.solve(h, f.T @ (p - target) + 1e-4 * ab)
        ab -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return float(ab[0] / spread), float(ab[1])
