"""Removal of bytes covered by long strings that occur elsewhere.

A byte goes if some string of ``length`` bytes over it also starts anywhere else in
the table, the same document included.  Sorting all suffixes would show it: a
window is repeated when its suffix shares ``length`` bytes with a neighbour.
Tuples for every byte are several times the input, so only sampled suffixes
are carried, and the result is induced for all others:

* Level 0.  Every window's sample is the position in it whose string of
  ``length - RANGE + 1`` bytes has the smallest hash (leftmost on ties).  That depends on the
  window's content alone, so equal windows have samples at equal offsets.  The
  windows of one sample are a range of offsets; a row carries the sample's
  name (the hash of what all windows of the widest range share) and the name of
  everything the windows of its own range cover.
* Induction.  Rows whose name is alone need no more: none of their windows is
  repeated.  Rows whose whole range has an equal are settled: all their windows
  are.  The rest, with one row to stand for each settled class beside them, is
  split into narrower ranges (``STEPS``) that carry longer common prefixes, down
  to single windows, where name and content are the same.

Names are grouped by Spark's external (spilling, disk-backed) shuffles and only
counts and one representative per name are ever gathered, so a string that a
third of all documents share costs one combined row per task; names with many
rows are joined by broadcast (``hot``), the ranges of equal rows are distinct.  Names are 64-bit hashes of content.

Null texts are empty.  Matches never cross documents.  Repeated rows are copies
of each other; rows that share an id (or have none) but not the text are separate
documents: rows are keyed by 80 bits of hashes of id and text.
An empty table gives no rows.  ``doc_id`` is an integer or null.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.batches import BASE, U64, Powers, covered, lean, mix
from scorecraft.llm.hot import join_counted
from scorecraft.llm.storage import cut, hold, let_go
from scorecraft.llm.stored import row_key, stored_texts, unpacked

LENGTH = 400
RANGE = 128                   # windows a sample can own; a power of two, less than the length
STEPS = (16, 1)               # widths of the ranges after level 0
ROW = "core long, full long, k long, at long"


def pack(p, lo, hi, mark):
    """Sample position, first and last offset of its range, text mark in one long."""
    return (p.astype(np.int64) << 32) | (lo.astype(np.int64) << 24) | (hi.astype(np.int64) << 16) | mark.astype(np.int64)


def samples(data, off, powers: Powers, length: int = LENGTH):
    """Level 0 over a slice of documents: (document, sample position, first and
    last offset of the range, core, full); positions count from the slice."""
    n, of_gram = len(data), length - RANGE + 1
    size = np.diff(off)
    z = np.zeros(0, np.int64)
    if not (size >= length).any():
        return z, z, z, z, z.astype(U64), z.astype(U64)
    prefix = powers.prefix(data)
    at = np.arange(n - of_gram + 1)
    gram = powers.spans(prefix, at, at + of_gram)
    low = U64(int(n).bit_length())
    least = ((gram >> low) << low) | at.astype(U64)             # smallest hash, leftmost on ties
    width = 1
    while width < RANGE:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    doc = np.repeat(np.arange(len(size)), size)[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + length <= off[1:][doc])
    owner = (least[start] & ((U64(1) << low) - U64(1))).astype(np.int64)
    new = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    first, last, p = start[new], start[np.r_[new[1:], len(start)] - 1], owner[new]
    lo, hi = p - last, p - first
    full = mix(powers.spans(prefix, first, last + length) ^ ((lo * RANGE + hi).astype(U64) * BASE))
    return doc[first], p, lo, hi, gram[p], full


def parts(prefix, p, lo, hi, step: int, powers: Powers, length: int = LENGTH):
    """Split ranges into grid ranges of ``step`` offsets: (index of the range,
    lo, hi, core, full)."""
    count = hi // step - lo // step + 1
    i = np.repeat(np.arange(len(p)), count)
    cell = (np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)) + (lo // step)[i]
    a, b = np.maximum(lo[i], cell * step), np.minimum(hi[i], cell * step + step - 1)
    at = p[i]
    core = mix(powers.spans(prefix, at - cell * step, at + length - cell * step - step + 1) ^ (cell.astype(U64) * BASE))
    full = mix(powers.spans(prefix, at - b, at - a + length) ^ ((a * RANGE + b).astype(U64) * BASE))
    return i, a, b, core, full


def _row_batch(core, full, k, at):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(full.view(np.int64)), pa.array(k), pa.array(at)],
                                      ["core", "full", "k", "at"])


def _level0(stored: DataFrame, length: int) -> DataFrame:
    def run(batches):
        powers = Powers()
        for batch in batches:
            for rows, data, off in unpacked(batch):
                doc, p, lo, hi, core, full = samples(data, off, powers, length)
                k, mark = (rows.column(c).to_numpy() for c in ("k", "mark"))
                yield _row_batch(core, full, k[doc], pack(p - off[doc], lo, hi, mark[doc]))

    return stored.mapInArrow(lean(run), ROW)


def _narrower(stored: DataFrame, open_rows: DataFrame, step: int, length: int) -> DataFrame:
    """The open rows split into ranges of ``step`` offsets, with their names."""
    wanted = open_rows.groupBy("k").agg(F.collect_set("at").alias("ats"))

    def run(batches):
        powers = Powers()
        for batch in batches:
            for rows, data, off in unpacked(batch):
                k, mark = (rows.column(c).to_numpy() for c in ("k", "mark"))
                ats = rows.column("ats").combine_chunks() if hasattr(rows.column("ats"), "combine_chunks") else rows.column("ats")
                doc = np.repeat(np.arange(len(k)), np.asarray(ats.value_lengths()))
                at = ats.flatten().to_numpy()
                mine = (at & 0xFFFF) == mark[doc]
                doc, at = doc[mine], at[mine]
                if len(at) == 0:
                    continue
                p, lo, hi = (at >> 32) + off[doc], (at >> 24) & 0xFF, (at >> 16) & 0xFF
                i, a, b, core, full = parts(powers.prefix(data), p, lo, hi, step, powers, length)
                doc = doc[i]
                yield _row_batch(core, full, k[doc], pack(p[i] - off[doc], a, b, mark[doc]))

    return stored.join(wanted, "k").select("k", "mark", "z", "ats").mapInArrow(lean(run), ROW)


def _resolve(rows: DataFrame, last: bool):
    """(settled rows, rows to split further) of one level, both written down so that
    the next level starts from a table.  So are the names, which each join reads several
    times: a held frame's plan is in the driver's memory as often as it is read."""
    rows = hold(rows)
    shared = cut(rows.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    several = join_counted(rows, shared, ["core"], total)
    if last:
        settled = cut(several.select("k", "at"))
        let_go(rows, shared)
        return settled, None
    several = hold(several)
    classes = cut(several.groupBy("core", "full")
                  .agg(F.count("*").alias("n"), F.min(F.struct("k", "at")).alias("one")))
    again = classes.filter("n > 1").select("core", "full", "n")
    settled = cut(join_counted(several, again, ["core", "full"], total).select("k", "at"))
    mixed = classes.groupBy("core").agg(F.count("*").alias("c")).filter("c > 1").select("core")
    open_rows = cut(classes.join(mixed, "core").select("one.k", "one.at"))
    let_go(rows, shared, several, classes)
    return settled, open_rows


def repeats(docs: DataFrame, *carried: str, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(stored texts, removal ranges (k, at)) of all documents."""
    if length <= RANGE:
        raise ValueError(f"strings of more than {RANGE} bytes only")
    stored = stored_texts(docs, *carried, key=row_key())
    rows, settled = _level0(stored, length), None
    for step in (*STEPS, None):
        done, open_rows = _resolve(rows, last=step is None)
        settled = done if settled is None else settled.unionByName(done)
        if step is not None:
            rows = _narrower(stored, open_rows, step, length)
    return stored, settled


def _joined(docs: DataFrame, *carried: str, length: int = LENGTH) -> DataFrame:
    stored, settled = repeats(docs, *carried, length=length)
    cuts = settled.groupBy("k").agg(F.collect_set("at").alias("ats"))
    return stored.join(cuts, "k", "left").select("k", "mark", "z", "ats", *carried)


def removal_mask(size: int, ats, mark: int, length: int = LENGTH):
    """Boolean mask of removed bytes of one document."""
    ats = ats[(ats & 0xFFFF) == mark]
    p, lo, hi = ats >> 32, (ats >> 24) & 0xFF, (ats >> 16) & 0xFF
    d = np.zeros(size + 1, np.int64)
    np.add.at(d, p - hi, 1)
    np.add.at(d, p - lo + length, -1)
    return np.cumsum(d[:-1]) > 0


def spans_of(mask):
    edge = np.diff(np.r_[False, mask, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _kept(rows, data, off, length: int):
    """Per document of a slice: (span starts, span ends, bytes kept)."""
    empty = np.zeros(0, np.int64)
    mark = rows.column("mark").to_numpy()
    for i, ats in enumerate(rows.column("ats")):
        raw = data[off[i]: off[i + 1]]
        mask = removal_mask(len(raw), ats.values.to_numpy() if ats.is_valid else empty, int(mark[i]), length)
        yield *spans_of(mask), raw[~mask].tobytes()


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: n_bytes, the removed spans (start, end bytes) and the bytes kept."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for rows, data, off in unpacked(batch):
                starts, ends, kept = zip(*_kept(rows, data, off, length))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("long_id_"), pa.array(np.diff(off)), pa.array(starts, pa.list_(pa.int64())),
                     pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "span_start", "span_end", "kept"])

    return _joined(docs.withColumn("long_id_", F.col("doc_id").cast("long")), "long_id_", length=length).mapInArrow(
        lean(run), "doc_id long, n_bytes long, span_start array<long>, span_end array<long>, kept binary")


def clean(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text and ``n_chars`` set anew.
    A character of which only some bytes remain goes too; null texts stay null."""
    carried = [c for c in docs.columns if c not in ("doc_id", "text")]
    flagged = docs.withColumn("null_text_", F.col("text").isNull()).withColumn("long_id_", F.col("doc_id").cast("long"))
    names, spark_schema = docs.columns, docs.schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for rows, data, off in unpacked(batch):
                null = np.asarray(rows.column("null_text_"))
                texts = [None if gone else t.decode("utf-8", "ignore")
                         for gone, (_, _, t) in zip(null.tolist(), _kept(rows, data, off, length))]
                made = {"doc_id": rows.column("long_id_"), "text": pa.array(texts, pa.string())}
                if "n_chars" in names:
                    made["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([made[c] if c in made else rows.column(c) for c in names], names)

    kind = {"doc_id": "long", "n_chars": "long"}
    out = ", ".join(f"`{f.name}` {kind.get(f.name, f.dataType.simpleString())}" for f in spark_schema)
    return _joined(flagged, *carried, "null_text_", "long_id_", length=length).mapInArrow(lean(run), out)


def digest(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return removed.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
                          F.size("span_start").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, for tests."""
    count: dict[bytes, int] = {}
    for t in texts:
        for s in range(len(t) - length + 1):
            count[t[s: s + length]] = count.get(t[s: s + length], 0) + 1
    out = []
    for t in texts:
        starts = np.array([s for s in range(len(t) - length + 1) if count[t[s: s + length]] > 1], np.int64)
        mask = covered(starts, length, len(t)) if len(t) else np.zeros(0, bool)
        kept = bytes(b for b, m in zip(t, mask.tolist()) if not m)
        out.append((len(t), len(t) - len(kept), len(spans_of(mask)[0]), hashlib.sha256(kept).hexdigest()))
    return out
