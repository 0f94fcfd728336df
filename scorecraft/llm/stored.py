"""Texts compressed and partitioned by id for operators with several passes.

One shuffle moves the texts; later passes join what they learned by id on the
same partitioning, so the texts do not move again.  The copy is kept in memory
with spill to disk and is recomputed where an executor is lost; as its shuffle files
stay for that, it takes up to twice its size of disk.  An operator that needs the copy once
or twice takes ``packed_texts`` and lets each shuffle go with the table written from it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.batches import SLICE_BYTES, lean, text_bytes
from scorecraft.llm.storage import hold

NO_ID = (1 << 63) - 1         # stands for a null id; the largest, so it never names a group of others


def row_key() -> Column:
    """Key of a row: 64-bit hash of id and text.  Equal rows share it; rows without an id
    do not, unless their texts are equal."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def packed_texts(docs: DataFrame, *carried: str, key: Column | None = None) -> DataFrame:
    """(k, mark, z, carried...), partitioned by k: id (``NO_ID`` for null) or ``key``, 16 bits of another
    hash of the text, the compressed text (null is empty) and the named columns."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) if key is None else key
    keyed = docs.select(key.alias("k"), F.pmod(F.hash("text"), F.lit(1 << 16)).cast("long").alias("mark"), "text", *carried)

    def run(batches):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, off, _ = text_bytes(batch.column("text"))
            raw = memoryview(data)
            z = [press.compress(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            rest = [batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("mark"), pa.array(z, pa.binary()), *rest],
                                             ["k", "mark", "z", *carried])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = ["k long", "mark long", "z binary", *[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried]]
    return keyed.mapInArrow(lean(run), ", ".join(kinds)).repartition(n, "k")


def stored_texts(docs: DataFrame, *carried: str, key: Column | None = None) -> DataFrame:
    """``packed_texts`` kept for several passes."""
    return hold(packed_texts(docs, *carried, key=key))


def unpacked(batch, most: int = SLICE_BYTES):
    """Slices (rows, bytes, offsets) of a batch with compressed texts ``z``."""
    import zstandard

    press, held, size, first = zstandard.ZstdDecompressor(), [], 0, 0

    def out(upto):
        off = np.r_[0, np.cumsum([len(t) for t in held])].astype(np.int64)
        return batch.slice(first, upto - first), np.frombuffer(b"".join(held), np.uint8), off

    for i, z in enumerate(batch.column("z")):
        raw = press.decompress(z.as_py())
        if held and size + len(raw) > most:
            yield out(i)
            held, size, first = [], 0, i
        held.append(raw)
        size += len(raw)
    if held:
        yield out(batch.num_rows)
