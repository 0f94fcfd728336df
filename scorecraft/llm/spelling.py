"""Spelling variants of words, grouped under their most frequent near word.

Two words are near if one inserted, deleted or replaced code point makes them
equal.  The letter counts of near words are at most 2 apart in squared distance,
so products of letter-count blocks (Gram matrices) find all candidates:

1. Occurrences are counted by Spark (``counted``): one row per distinct word.
2. Words are dealt to cells: the counts of letters in ``CLASSES`` classes, whose sum
   is the length.  A replaced letter moves a word to a cell of the same length, a
   deleted one to a cell of the length below; a cell's number is a linear hash of its
   counts, so the numbers of those neighbours are sums and differences.
3. The words of a cell are packed into blocks of at most ``BLOCK`` words (``blocks``).
   Every block visits the blocks of its own cell from its own on, of the neighbour cells of
   its length with a smaller number, and of the neighbour cells one letter shorter; so each
   pair of words meets once.  A cell with many words has many blocks, each a key of
   its own in the join, so no task gets a whole cell.
4. A task multiplies the letter counts of two blocks; pairs at most 2 apart are
   verified letter by letter (``near_pairs``), and each word's count of near words and
   best near word go to a grouped aggregation (``near_words``).
5. Roots follow the forms by pointer doubling (``roots``): a form has at least
   twice the occurrences, so chains are short.

Words are runs of Latin letters, deletions and folding see ``slice_words``.  Null texts
have no words; a null id is written as nothing in the hash.  Repeated rows count
repeatedly.  Tables without rows give none; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.batches import BASE, SLICE_BYTES, U64, Powers, byte_class, lower_ascii, mix, salts, slices
from scorecraft.llm.storage import cut, hold

RUN = r"[A-Za-zÀ-ÿ]+"
ASCII_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A))
ONE_IN = 97                   # runs whose hash it divides lose a code point
SHORTEST, RAREST = 5, 3       # code points and occurrences of a word
CLASSES = 5                   # of letters: code point modulo CLASSES
BLOCK = 1024                  # words of a block
DIMS = 32                     # of the letter counts: a-z and six for all other letters
STEP = salts(CLASSES, 61)     # cell number: the counts times these, modulo 2**64
LONG = 64                     # bytes of a run up to which crc32 is computed for all runs at once


def _crc_table():
    """crc32 of a register that holds one byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


CRC = _crc_table()


def letter_runs(data, off):
    """Runs of letters inside one document: (first byte, end, code points, document).  In
    UTF-8 the letters beyond ASCII are 0xC3 and a continuation byte."""
    lead = np.flatnonzero(data == 0xC3)
    inside = ASCII_LETTER[data]
    inside[lead] = True
    inside[lead + 1] = True
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]]))
    end = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False])) + 1
    two = np.zeros(len(data) + 1, np.int32)
    two[lead + 1] = 1
    two = np.cumsum(two, dtype=np.int32)
    return start, end, end - start - (two[end] - two[start]), np.searchsorted(off, start, side="right") - 1


def crcs(data, start, end, seeds):
    """crc32 of the byte spans, each going on from the crc32 in ``seeds``."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    reg = seeds[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    for step in range(int(min(left[0], LONG)) if len(left) else 0):
        n = int(np.searchsorted(-left, -step, side="left"))          # spans longer than the step
        reg[:n] = CRC[(reg[:n] ^ data[at[:n] + step]) & np.uint32(255)] ^ (reg[:n] >> np.uint32(8))
    reg ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(-left, -LONG, side="left"))):
        reg[i] = zlib.crc32(data[at[i] + LONG: at[i] + left[i]].tobytes(), int(reg[i]))
    out = np.empty_like(reg)
    out[order] = reg
    return out


def slice_words(ids: list[str], data, off, powers: Powers):
    """(words as Arrow strings, occurrences) of a slice of documents, each word once, and the
    words that lost a code point: A-Z in lower case; where ``ONE_IN`` divides the crc32
    h of ``<doc_id>:<run>``, without its code point h % length."""
    import pyarrow as pa

    data = lower_ascii(data)
    start, end, size, doc = letter_runs(data, off)
    start, end, size, doc = (x[size >= SHORTEST] for x in (start, end, size, doc))
    name = powers.spans(powers.prefix(data), start, end)
    _, first, n = np.unique(mix(name ^ (doc.astype(U64) * BASE)), return_index=True, return_counts=True)
    start, end, size, doc, name = (x[first] for x in (start, end, size, doc, name))
    h = crcs(data, start, end, np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)[doc] if len(doc) else doc)
    hit = h % ONE_IN == 0
    words, counts = [], []
    for i in np.flatnonzero(hit & (size > SHORTEST)).tolist():
        word, at = data[start[i]: end[i]].tobytes().decode(), int(h[i]) % int(size[i])
        words.append(word[:at] + word[at + 1:])
        counts.append(int(n[i]))
    yield pa.array(words, pa.string()), pa.array(counts, pa.int64())
    start, end, name, n = (x[~hit] for x in (start, end, name, n))
    _, first, which = np.unique(name, return_index=True, return_inverse=True)
    start, end = start[first], end[first]
    bounds = np.r_[0, np.cumsum(end - start)]
    at = np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], end - start)
    yield (pa.StringArray.from_buffers(len(start), pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data[at].tobytes())),
           pa.array(np.bincount(which, weights=n, minlength=len(start)).astype(np.int64)))


def counted(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of at least ``SHORTEST`` code points and ``RAREST`` occurrences."""
    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text").filter("text IS NOT NULL")

    def run(batches):
        import pyarrow as pa

        powers = Powers()
        for batch in batches:
            for rows, data, off, _ in slices(batch, most=2 * SLICE_BYTES):
                for words, n in slice_words(rows.column("id").to_pylist(), data, off, powers):
                    yield pa.RecordBatch.from_arrays([words, n], ["word", "n"])

    words = named.mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= RAREST)


def letters(words: list[bytes]):
    """(bytes of all words, index of the word of each byte)."""
    data = np.frombuffer(b"".join(words), np.uint8)
    return data, np.repeat(np.arange(len(words)), [len(w) for w in words])


def class_counts(words: list[bytes]):
    data, word = letters(words)
    return np.bincount(word * CLASSES + data % CLASSES, minlength=len(words) * CLASSES).reshape(-1, CLASSES)


def cell_of(counts):
    return (counts.astype(U64) * STEP).sum(axis=-1, dtype=U64)


def neighbours(counts) -> list[int]:
    """Numbers of the cells that the words of a cell visit besides their own: those of the
    same length with a smaller number, and those one letter shorter."""
    own, held = int(cell_of(counts)), np.flatnonzero(counts)
    shorter = U64(own) - STEP[held]
    same = (shorter[:, None] + STEP[None, :]).ravel()
    found = np.unique(np.r_[shorter, same[same < U64(own)]])
    return found[found != U64(own)].view(np.int64).tolist()


def blocks(words: DataFrame) -> DataFrame:
    """Words (word, n) packed by cell: (cell, no, blocks, size, letters, ns, to): the blocks of
    a cell are numbered from 0, ``letters`` are the words' Latin-1 bytes one after the other in
    code-point order, ``to`` the neighbour cells."""
    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            raw = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            yield batch.append_column("cell", pa.array(cell_of(class_counts(raw)).view(np.int64) if raw else [], pa.int64()))

    def pack(batches):
        import pyarrow as pa

        def row(cell, ws, ns):
            to = neighbours(class_counts(ws[:1])[0])
            return pa.RecordBatch.from_pylist([{"cell": cell, "first": ws[0].decode("latin-1"), "size": len(ws[0]),
                                                "letters": b"".join(ws), "ns": ns, "to": to}], schema)

        schema = pa.schema([("cell", pa.int64()), ("first", pa.string()), ("size", pa.int32()), ("letters", pa.binary()),
                            ("ns", pa.list_(pa.int64())), ("to", pa.list_(pa.int64()))])
        now, ws, ns = None, [], []
        for batch in batches:
            for cell, w, n in zip(*(batch.column(c).to_pylist() for c in ("cell", "word", "n"))):
                w = w.encode("latin-1")
                if ws and (cell != now or len(ws) == BLOCK or len(w) != len(ws[0])):
                    yield row(now, ws, ns)
                    ws, ns = [], []
                now = cell
                ws.append(w)
                ns.append(n)
        if ws:
            yield row(now, ws, ns)

    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = hold(words.mapInArrow(deal, "word string, n long, cell long").repartitionByRange(n, "cell", "word"))
    packed = hold(dealt.sortWithinPartitions("cell", "word").mapInArrow(
        pack, "cell long, first string, size int, letters binary, ns array<long>, to array<long>"))
    # The names of a cell's blocks, not the blocks, meet to be numbered.
    named = packed.groupBy("cell").agg(F.array_sort(F.collect_list("first")).alias("names"))
    placed = named.select("cell", F.posexplode("names").alias("no", "first"), F.size("names").alias("blocks"))
    return packed.join(placed, ["cell", "first"]).drop("first")


def near_pairs(a, b, same: bool):
    """Index pairs of near words of two letter arrays (a row per word); the words of ``b``
    are as long or one letter longer; ``same``: the arrays are one block."""
    counts = []
    for x in (a, b):
        dim = np.where(x < 128, x.astype(np.int64) - 97, 26 + x.astype(np.int64) % 6)
        flat = (np.arange(len(x))[:, None] * DIMS + dim).ravel()
        counts.append(np.bincount(flat, minlength=len(x) * DIMS).reshape(-1, DIMS).astype(np.float32))
    ca, cb = counts
    gram = ca @ cb.T
    gram *= -2
    gram += (ca * ca).sum(axis=1)[:, None]
    gram += (cb * cb).sum(axis=1)[None, :]
    i, j = np.divmod(np.flatnonzero(gram.ravel() <= 2), len(b))
    if same:
        i, j = i[i < j], j[i < j]
    keep, size, step = [], a.shape[1], max(1, 4_000_000 // a.shape[1])
    for lo in range(0, len(i), step):
        x, y = a[i[lo: lo + step]], b[j[lo: lo + step]]
        if b.shape[1] == size:
            keep.append((x != y).sum(axis=1) == 1)
        else:
            end = np.ones((len(x), 1), bool)
            lead = np.argmax(np.hstack([x != y[:, :-1], end]), axis=1)
            trail = np.argmax(np.hstack([(x != y[:, 1:])[:, ::-1], end]), axis=1)
            keep.append(lead + trail >= size)
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[keep], j[keep]


def best_of(i, j, n_of):
    """Per word of ``i``: (word, number of near words, its best j: largest ``n_of``, then smallest j)."""
    order = np.lexsort((j, -n_of[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
    return i[first], np.diff(np.r_[first, len(i)]), j[first]


def near_words(packed: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of every word with a near word."""
    visitor = packed.select(F.col("cell").alias("from_cell"), F.col("no").alias("from_no"), F.col("letters").alias("v_letters"),
                            F.col("ns").alias("v_ns"), F.col("size").alias("v_size"), "to", "blocks")
    sizes = packed.groupBy("cell").agg(F.first("blocks").alias("blocks"))
    others = (visitor.drop("blocks").withColumn("cell", F.explode("to")).join(sizes, "cell")
              .withColumn("no", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    own = (visitor.withColumn("cell", F.col("from_cell"))
           .withColumn("no", F.explode(F.sequence(F.col("from_no"), F.col("blocks") - 1))))
    columns = ["cell", "no", "from_cell", "from_no", "v_letters", "v_ns", "v_size"]
    visits = others.select(*columns).unionByName(own.select(*columns))
    pairs = visits.join(packed.select("cell", "no", "letters", "ns", "size"), ["cell", "no"]).withColumn(
        "same", (F.col("cell") == F.col("from_cell")) & (F.col("no") == F.col("from_no")))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cols = [batch.column(c) for c in ("letters", "size", "ns", "v_letters", "v_size", "v_ns", "same")]
            out: list[list] = [[], [], [], []]
            for raw, size, ns, v_raw, v_size, v_ns, same in zip(*cols):
                size, v_size = size.as_py(), v_size.as_py()
                if v_size not in (size, size + 1):
                    continue                                    # cells whose numbers coincide
                a, b = (np.frombuffer(r.as_py(), np.uint8).reshape(-1, s) for r, s in ((raw, size), (v_raw, v_size)))
                na, nb = ns.values.to_numpy(), v_ns.values.to_numpy()
                i, j = near_pairs(a, b, same.as_py())
                for x, y, mine, theirs, n_of in ((i, j, a, b, nb), (j, i, b, a, na)):
                    at, count, best = best_of(x, y, n_of)
                    out[0] += [r.tobytes().decode("latin-1") for r in mine[at]]
                    out[1].append(count)
                    out[2].append(n_of[best])
                    out[3] += [r.tobytes().decode("latin-1") for r in theirs[best]]
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0]), pa.array(np.concatenate(out[1])), pa.array(np.concatenate(out[2])), pa.array(out[3])],
                    ["word", "n_near", "best_n", "best"])

    found = pairs.select("letters", "size", "ns", "v_letters", "v_size", "v_ns", "same").mapInArrow(
        run, "word string, n_near long, best_n long, best string")
    grouped = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("b"))
    return grouped.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of every word with a form, from (word, up): each round doubles the way
    that a word has gone, until none goes on."""
    now = cut(links.select("word", "up", F.lit(True).alias("moved")))
    while not now.filter("moved").isEmpty():
        onward = now.select(F.col("word").alias("mid"), F.col("up").alias("next"))
        now = cut(now.join(onward, now["up"] == onward["mid"], "left").select(
            "word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), instead_of=now)
    return now.select("word", F.col("up").alias("root"))


def group(docs: DataFrame) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n (see the module and ``counted``).  The
    form is the near word of largest n (ties: smallest) if that is at least twice the word's."""
    words = cut(counted(docs))
    near = near_words(hold(blocks(words)))
    formed = cut(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        *[F.when(F.col("best_n") >= 2 * F.col("n"), F.col(c)).alias(name) for c, name in (("best", "form"), ("best_n", "form_n"))]))
    up = roots(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("up")))
    return formed.join(up, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def brute_force(texts: list[tuple]) -> set[tuple]:
    """The rows of ``group`` for (doc_id, text) pairs, for tests."""
    import re
    import zlib
    from collections import Counter

    count: Counter = Counter()
    for i, text in texts:
        for run in re.findall(RUN, text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            count[run[:at] + run[at + 1:] if h % ONE_IN == 0 else run] += 1
    n = {w: c for w, c in count.items() if len(w) >= SHORTEST and c >= RAREST}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))

    at = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in at.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(at[w]), n[form[w]] if w in form else None) for w in n}
