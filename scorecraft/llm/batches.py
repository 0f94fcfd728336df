"""Arrow text batches as byte arrays, and the vectorised hashes over them.

The operators of this subpackage run inside ``mapInArrow``: Spark partitions
the rows, and every task walks its Arrow batches in slices of a few MB, so the
memory of a task follows the slice (or one longer document), not the batch.
All hashes are 64 bit, wrap on overflow and depend on content alone.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)          # odd, so it has an inverse modulo 2**64
SLICE_BYTES = 1 << 20


def give_back() -> None:
    """Freed memory that the allocators of this process keep goes back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)       # glibc has it
    if trim is not None:
        trim(0)


def lean(run):
    """``run`` of ``mapInArrow``, its memory given back after the last batch: Spark keeps Python
    workers for later tasks and stages, which have an executor's memory to share."""
    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def mix(h):
    """Finalising mix of 64-bit values (a new array)."""
    h = h ^ (h >> U64(31))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(32)
    return h


def salts(n: int, seed: int):
    """``n`` odd pseudo-random 64-bit multipliers."""
    return mix((np.arange(n, dtype=U64) + U64(1)) * BASE + U64(seed)) | U64(1)


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)
        self.inverse = U64(pow(int(BASE), -1, 1 << 64))
        self.byte = salts(256, 7)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", BASE), ("down", self.inverse)):
                a = np.full(size, base, U64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def prefix(self, data):
        """Prefix sums ``H`` of the bytes' hash terms, one longer than ``data``."""
        self.reach(len(data) + 1)
        h = np.zeros(len(data) + 1, U64)
        np.cumsum(self.byte[data] * self.up[: len(data)], out=h[1:])
        return h

    def spans(self, prefix, start, end):
        """Hashes of the byte spans ``[start, end)``, independent of their place."""
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(U64))


def text_bytes(column):
    """(bytes, offsets, is_null) of an Arrow string column; null is empty."""
    import pyarrow as pa

    n = len(column)
    null = np.asarray(column.is_null())
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), null
    if column.null_count:
        column = column.fill_null("")
    if column.type in (pa.large_string(), pa.large_binary()):
        kind = np.int64
    else:
        kind = np.int32
    _, off, data = column.buffers()
    off = np.frombuffer(off, kind)[column.offset: column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0], null


def slices(batch, text: str = "text", most: int = SLICE_BYTES):
    """Slices ``(rows, bytes, offsets, is_null)`` of an Arrow batch of at most
    ``most`` bytes of text, or of one longer document."""
    data, off, null = text_bytes(batch.column(text))
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i), data[off[i]: off[j]], off[i: j + 1] - off[i], null[i:j]
        i = j


def byte_class(*members) -> np.ndarray:
    """Boolean table over byte values; members are values or (first, last)."""
    t = np.zeros(256, bool)
    for m in members:
        lo, hi = m if isinstance(m, tuple) else (m, m)
        t[lo: hi + 1] = True
    return t


#: Words ``[^\x20\x09-\x0D]+``: everything but ASCII white space.
SPACED = ~byte_class(0x20, (0x09, 0x0D))
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after ASCII lower-casing.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def lower_ascii(data):
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table[data]


def runs(data, off, member):
    """Maximal runs of bytes in class ``member`` that stay inside one document:
    (start, end, document)."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = member[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = off[:-1][off[:-1] < len(data)]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = off[1:][off[1:] > 0] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def per_row(counts_of, n: int):
    """How often each row index 0..n-1 occurs."""
    return np.bincount(counts_of, minlength=n).astype(np.int64)


def windows(words, doc, k: int, seed: int):
    """Hashes of the windows of ``k`` consecutive words inside one document:
    (hash, index of the first word)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[k - 1:])
    h = np.zeros(n, U64)
    for j, s in enumerate(salts(k, seed)):
        h += words[j: j + n] * s
    return mix(h[at]), at


def covered(starts, length: int, n: int):
    """Boolean mask over ``n`` places of those inside ``[s, s + length)`` of any start."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + length, n), -1)
    return np.cumsum(d[:-1]) > 0
