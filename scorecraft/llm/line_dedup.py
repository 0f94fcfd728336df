"""Removal of lines that many documents hold, found by two Bloom filters.

A line's key is the line without ASCII white space at both ends, A-Z in lower case.
Keys of at least ``CHARS`` code points that at least ``DOCS`` documents hold lose all their
lines but those of the largest doc_id that holds them.

1. ``suspects_filter``: every task enters the 64-bit hashes of its keys, once per document,
   into a filter of bits seen once and one of bits seen twice.  The filters of all tasks
   are merged piece by piece: a bit is seen twice if any task saw it twice or two tasks saw
   it once.  All bits of a key that two documents hold are seen twice.
2. Only lines whose bits were all seen twice are shuffled (``suspects``), as 128-bit hashes of
   their key and the place of the line; documents are counted exactly, and the largest
   doc_id is chosen (``repeated``).
3. The lines to drop are gathered per document.  A Bloom filter of those documents
   (``rows_filter``) sends the others past the shuffle of texts: they stay as they are.

The filters have ``2 ** bits`` bits whatever the input is (16 MB each at 27), so what is
broadcast is bounded.  With more lines than the filters can tell apart, more lines are
suspects and more texts are joined; the result is the same.  Keys that hold a large share
of all suspects are joined by broadcast: at most ``HOT`` keys can hold 1/``HOT`` of them each.

Null and empty texts are one empty line.  Rows that share an id are one document; rows
without an id are together one document smaller than all others.  Equal rows get equal
results.  Tables without rows give none; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.batches import SPACED, U64, Powers, lower_ascii, mix, salts, slices
from scorecraft.llm.storage import cut, hold

DOCS, CHARS = 3, 20
BITS = 27                     # log2 of the bits of a filter
HASHES = 4                    # bits of a key
PIECE = 16                    # log2 of the bytes of a piece of a filter
FLUSH = 1 << 20               # hashes that a task holds before it enters them
HOT = 10_000
NO_ID = -(1 << 63)
TURN = salts(HASHES, 71)


def lines_of(data, off):
    """Lines of a slice of documents: (start, end, document, start and end of the key)."""
    breaks = np.flatnonzero(data == 0x0A)
    start = np.r_[off[:-1], breaks + 1]
    doc = np.r_[np.arange(len(off) - 1), np.searchsorted(off, breaks, side="right") - 1]
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    last = np.r_[doc[1:] != doc[:-1], True]
    end = np.where(last, off[1:][doc], np.r_[start[1:], 0] - 1)
    solid = np.r_[0, np.cumsum(SPACED[data])]
    where = np.r_[np.flatnonzero(SPACED[data]), len(data)]
    blank = solid[start] == solid[end]
    first = np.where(blank, start, where[solid[start]])
    past = np.where(blank, start, where[np.maximum(solid[end], 1) - 1] + 1)
    return start, end, doc, first, past


def code_points(data, start, end):
    n = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    return n[end] - n[start]


def long_keys(data, off, powers: Powers, chars: int):
    """(lower-cased bytes, key start, key end, document, line number in the document, hash)
    of the lines whose key is long enough."""
    start, _, doc, first, past = lines_of(data, off)
    number = np.arange(len(doc)) - np.searchsorted(doc, doc, side="left")
    keep = code_points(data, first, past) >= chars
    low = lower_ascii(data)
    first, past, doc, number = first[keep], past[keep], doc[keep], number[keep]
    return low, first, past, doc, number, powers.spans(powers.prefix(low), first, past)


class Bits:
    """A filter of ``2 ** bits`` bits."""

    def __init__(self, bits: int, data=None):
        self.bits = bits
        self.data = np.zeros(1 << (bits - 3), np.uint8) if data is None else data

    def places(self, h):
        return (mix(h[:, None] ^ TURN[None, :]) >> U64(64 - self.bits)).astype(np.int64)

    def test(self, at):
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def set(self, at) -> None:
        """Set sorted distinct places."""
        if len(at):
            byte = at >> 3
            first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
            self.data[byte[first]] |= np.bitwise_or.reduceat(np.uint8(1) << (at & 7).astype(np.uint8), first)

    def holds(self, h):
        """Whether all bits of each hash are set."""
        return self.test(self.places(h)).all(axis=1)


def enter(once: Bits, twice: Bits, h) -> None:
    at, n = np.unique(once.places(h).ravel(), return_counts=True)
    twice.set(at[(n > 1) | once.test(at)])
    once.set(at)


def _pieces(once: Bits, twice: Bits):
    """The pieces that are not empty as Arrow rows (piece, once, twice), compressed."""
    import pyarrow as pa
    import zstandard

    press, step = zstandard.ZstdCompressor(level=1), 1 << PIECE
    for i in range(max(1, len(once.data) >> PIECE)):
        a, b = (f.data[i * step: (i + 1) * step] for f in (once, twice))
        if a.any():
            yield pa.RecordBatch.from_pydict({"piece": [i], "once": [press.compress(a)], "twice": [press.compress(b)]},
                                             pa.schema([("piece", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))


def _merged(parts: DataFrame, bits: int, seen: str) -> Bits:
    """The filter of all tasks' pieces: bits seen ``once`` or ``twice``.  Pieces are merged on
    the executors; the driver puts together one filter of bounded size."""
    def run(batches):
        import pyarrow as pa
        import zstandard

        squeeze, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        now, once, twice = None, None, None

        def row():
            return pa.RecordBatch.from_pydict({"piece": [now], "bits": [press.compress(twice if seen == "twice" else once)]},
                                              pa.schema([("piece", pa.int32()), ("bits", pa.binary())]))

        for batch in batches:
            for piece, a, b in zip(batch.column("piece").to_pylist(), batch.column("once"), batch.column("twice")):
                a, b = (np.frombuffer(squeeze.decompress(x.as_py()), np.uint8) for x in (a, b))
                if piece != now:
                    if now is not None:
                        yield row()
                    now, once, twice = piece, a.copy(), b.copy()
                else:
                    twice |= b | (once & a)
                    once |= a
        if now is not None:
            yield row()

    import zstandard

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = parts.repartition(n, "piece").sortWithinPartitions("piece").mapInArrow(run, "piece int, bits binary")
    out, squeeze = Bits(bits), zstandard.ZstdDecompressor()
    for r in merged.toLocalIterator():
        piece = np.frombuffer(squeeze.decompress(r["bits"]), np.uint8)
        out.data[r["piece"] << PIECE: (r["piece"] << PIECE) + len(piece)] = piece
    return out


def _filter_parts(rows: DataFrame, hashes_of, bits: int) -> DataFrame:
    """Pieces of each task's filters of ``hashes_of(batch)``."""
    def run(batches):
        once, twice, held, n = Bits(bits), Bits(bits), [], 0
        for batch in batches:
            for h in hashes_of(batch):
                held.append(h)
                n += len(h)
                if n >= FLUSH:
                    enter(once, twice, np.concatenate(held))
                    held, n = [], 0
        if n:
            enter(once, twice, np.concatenate(held))
        yield from _pieces(once, twice)

    return rows.mapInArrow(run, "piece int, once binary, twice binary")


def suspects_filter(docs: DataFrame, chars: int = CHARS, bits: int = BITS) -> Bits:
    """Filter of the keys that two documents may hold."""
    powers = Powers()

    def hashes_of(batch):
        for _, data, off, _ in slices(batch):
            _, _, _, doc, _, h = long_keys(data, off, powers, chars)
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            yield h[np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]] if len(h) else h

    return _merged(_filter_parts(docs.select("text"), hashes_of, bits), bits, "twice")


def rows_filter(marks: DataFrame, bits: int = BITS) -> Bits:
    """Filter of the rows named by ``k``."""
    return _merged(_filter_parts(marks.select("k"), lambda b: [b.column("k").to_numpy().view(U64)], bits), bits, "once")


def keyed(docs: DataFrame) -> DataFrame:
    """(k, k2, id, doc_id, text): two hashes name the row, ``id`` is ``NO_ID`` for null."""
    number = F.col("doc_id").cast("long")
    return docs.select(F.xxhash64(number, "text").alias("k"), F.hash("text", number).alias("k2"),
                       F.coalesce(number, F.lit(NO_ID)).alias("id"), "doc_id", "text")


def suspects(rows: DataFrame, seen: Bits, chars: int = CHARS) -> DataFrame:
    """(key, id, k, k2, line) of the lines that ``seen`` does not clear."""
    shared = rows.sparkSession.sparkContext.broadcast(seen.data)
    bits = seen.bits

    def run(batches):
        import pyarrow as pa
        import xxhash

        powers, known = Powers(), Bits(bits, shared.value)
        for batch in batches:
            for part, data, off, _ in slices(batch):
                low, start, end, doc, number, h = long_keys(data, off, powers, chars)
                at = np.flatnonzero(known.holds(h))
                raw = memoryview(low)
                key = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(start[at].tolist(), end[at].tolist())]
                row = pa.array(doc[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.binary()), *[part.column(c).take(row) for c in ("id", "k", "k2")], pa.array(number[at])],
                    ["key", "id", "k", "k2", "line"])

    return rows.select("id", "k", "k2", "text").mapInArrow(run, "key binary, id long, k long, k2 int, line long")


def repeated(found: DataFrame, least: int = DOCS) -> DataFrame:
    """(key, last, n) of the keys that enough documents hold: largest id, number of lines."""
    counts = found.groupBy("key").agg(F.countDistinct("id").alias("docs"), F.max("id").alias("last"), F.count("*").alias("n"))
    return counts.filter(F.col("docs") >= least).select("key", "last", "n")


def dropped(found: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, k2, drop): per row the numbers of the lines to drop."""
    total = found.count()
    hot = F.broadcast(keys.filter(F.col("n") * HOT > total).select("key", "last"))       # fewer than HOT keys
    rest = keys.filter(F.col("n") * HOT <= total).select("key", "last")
    hit = found.join(hot, "key").unionByName(found.join(hot.select("key"), "key", "left_anti").join(rest, "key"))
    return hit.filter(F.col("id") < F.col("last")).groupBy("k", "k2").agg(F.collect_set("line").alias("drop"))


def dedup(docs: DataFrame, least: int = DOCS, chars: int = CHARS, bits: int = BITS) -> DataFrame:
    """Per document: doc_id, n_lines (before), n_dropped, kept (text of the other lines)."""
    rows = keyed(docs)
    found = cut(suspects(rows, suspects_filter(docs, chars, bits), chars))
    marks = cut(dropped(found, hold(repeated(found, least))))
    touched = rows_filter(marks, bits)
    shared, size = rows.sparkSession.sparkContext.broadcast(touched.data), touched.bits

    @F.arrow_udf("boolean")
    def maybe(k):
        import pyarrow as pa

        return pa.array(Bits(size, shared.value).holds(k.to_numpy().view(U64)))

    routed = rows.withColumn("maybe", maybe("k"))
    text = F.coalesce("text", F.lit(""))
    as_is = routed.filter("NOT maybe").select(
        "doc_id", (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.lit(0).cast("long").alias("n_dropped"), text.alias("kept"))
    joined = routed.filter("maybe").drop("maybe").join(marks, ["k", "k2"], "left").select("doc_id", "text", "drop")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, data, off, _ in slices(batch):
                drop = part.column("drop")
                n_lines, n_dropped, kept = [], [], []
                for i in range(len(part)):
                    lines = data[off[i]: off[i + 1]].tobytes().split(b"\n")
                    gone = set(drop[i].as_py() or ())
                    n_lines.append(len(lines))
                    n_dropped.append(len(gone))
                    kept.append(b"\n".join([x for j, x in enumerate(lines) if j not in gone]).decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_lines), pa.array(n_dropped), pa.array(kept, pa.string())],
                    ["doc_id", "n_lines", "n_dropped", "kept"])

    rewritten = joined.mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, kept string")
    return as_is.unionByName(rewritten)


def digest(cleaned: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(texts: list[tuple], least: int = DOCS, chars: int = CHARS) -> list[tuple]:
    """(doc_id, n_lines, n_dropped, kept_sha256) per (doc_id, text) pair, for tests."""
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip("\x20\x09\x0a\x0b\x0c\x0d"))

    holders: dict[str, set] = {}
    split = [(NO_ID if i is None else i, (t or "").split("\n")) for i, t in texts]
    for i, lines in split:
        for line in lines:
            holders.setdefault(key(line), set()).add(i)
    gone = {k: max(ids) for k, ids in holders.items() if len(ids) >= least and len(k) >= chars}
    out = []
    for (doc_id, _), (i, lines) in zip(texts, split):
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == i]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out
