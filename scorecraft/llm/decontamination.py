"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of training documents inside a Spark task (a few MB of
text).  Its word sequence -- benchmark words by number, every other word and
every document end as a terminator -- is indexed: suffix order, Burrows-Wheeler
transform, wavelet matrix for ranks, and the suffix positions at every
``SAMPLE``-th place of the text.  All windows of the benchmark (10 consecutive
words of an item; a shorter item whole) are searched backward at once, their
occurrences are located by walking to the next sampled position, and the
removal spans of a document are merged.

The benchmark is searched in blocks of at most ``BLOCK_BYTES`` of text (or one
item).  Tasks derive the search sets of the blocks, one row each of a table in
the checkpoint folder.  With several blocks the documents are written there too,
under a key per row; one block after the other is sent to the tasks, its hits
are written and the broadcast is given back, and the spans of a row are merged
by one grouping.

Null and empty texts and items have no words and so no windows.  Equal windows
of several items count for each item; items or documents that repeat are
treated one by one.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.batches import ALNUM, U64, Powers, lower_ascii, mix, per_row, runs, salts, slices, windows
from scorecraft.llm.storage import cut

WORDS = 10
SAMPLE = 8
BLOCK_BYTES = 32 << 20
END = 0                       # terminator symbol of the indexed sequence


def suffix_order(seq, bits: int):
    """Suffix array of ``seq`` where every terminator is smaller than any word and
    earlier terminators are smaller than later ones.  Ranks over growing
    prefixes are doubled; only suffixes that still share a rank are sorted again."""
    n = len(seq)
    k = max(1, 62 // bits)
    # First key: as many symbols as fit one integer; after a terminator nothing counts.
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(k):
        part = np.zeros(n, np.int64)
        part[: max(n - j, 0)] = seq[j:]
        part[~alive] = 0
        key = (key << bits) | part
        alive &= part > 0
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    group = np.r_[True, sorted_key[1:] != sorted_key[:-1]] if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    head = np.maximum.accumulate(np.where(group, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    rank[order] = head
    # A suffix that met a terminator within the first key is placed by position (stable).
    ended = ~alive
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    rank[ended] = place[ended]
    size = k
    while True:
        same = np.zeros(n, bool)
        r = rank[order]
        same[1:] |= r[1:] == r[:-1]
        same[:-1] |= r[1:] == r[:-1]
        at = np.flatnonzero(same)
        if len(at) == 0:
            return order
        items = order[at]
        after = np.minimum(items + size, n - 1)           # exists: a suffix without a terminator is longer
        key = rank[items] * np.int64(n) + rank[after]
        turn = np.argsort(key, kind="stable")
        order[at] = items[turn]
        key = key[turn]
        new = np.r_[True, key[1:] != key[:-1]]
        rank[order[at]] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        size *= 2


class WaveletMatrix:
    """Ranks of any symbol in a sequence, by one bit per level, high bit first."""

    def __init__(self, seq, bits: int):
        self.bits, self.counts, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.counts.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol, lo, hi):
        """Occurrences of ``symbol`` before ``lo`` and before ``hi``."""
        start = np.zeros_like(lo)
        for i, (ones, zeros) in enumerate(zip(self.counts, self.zeros)):
            one = ((symbol >> (self.bits - 1 - i)) & 1).astype(bool)
            lo, hi, start = (np.where(one, zeros + ones[x], x - ones[x]) for x in (lo, hi, start))
        return lo - start, hi - start

    def access_rank(self, at):
        """(symbol at each place, its occurrences before that place)."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for ones, zeros in zip(self.counts, self.zeros):
            one = (ones[at + 1] - ones[at]).astype(bool)
            symbol = (symbol << 1) | one
            at, start = (np.where(one, zeros + ones[x], x - ones[x]) for x in (at, start))
        return symbol, at - start


class FMIndex:
    """Index of one sequence of symbols; the last symbol is a terminator."""

    def __init__(self, seq, bits: int):
        order = suffix_order(seq, bits)
        self.bwt = WaveletMatrix(seq[order - 1], bits)        # order - 1 wraps: the sequence is a circle
        self.first = np.r_[0, np.cumsum(np.bincount(seq, minlength=1 << bits))].astype(np.int64)
        # Sampled: every SAMPLE-th position, and those after a terminator, which a walk must
        # not cross (terminators are ordered by position, not by what follows them).
        self.sampled = (order % SAMPLE == 0) | (seq[order - 1] == END)
        self.before = np.r_[0, np.cumsum(self.sampled)]
        self.position = order[self.sampled]
        self.n = len(seq)

    def search(self, words, first, lengths):
        """Row intervals [lo, hi) of patterns, given as ranges of ``words``."""
        lo, hi = np.zeros(len(first), np.int64), np.full(len(first), self.n, np.int64)
        for j in range(1, int(lengths.max()) + 1):
            live = np.flatnonzero((j <= lengths) & (hi > lo))
            if len(live) == 0:
                continue
            c = words[first[live] + lengths[live] - j].astype(np.int64)
            a, b = self.bwt.rank(c, lo[live], hi[live])
            lo[live], hi[live] = self.first[c] + a, self.first[c] + b
        return lo, np.maximum(hi, lo)

    def locate(self, row):
        """Text positions of rows: step back until a sampled position is met."""
        at, steps, out = row.copy(), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        open_ = np.arange(len(row))
        while len(open_):
            done = self.sampled[at[open_]]
            hit = open_[done]
            out[hit] = self.position[self.before[at[hit]]] + steps[hit]
            open_ = open_[~done]
            symbol, rank = self.bwt.access_rank(at[open_])
            at[open_] = self.first[symbol] + rank
            steps[open_] += 1
        return out


def split_words(data, off, powers: Powers):
    """(word hashes, start byte, end byte, document) of lower-cased words."""
    data = lower_ascii(data)
    start, end, doc = runs(data, off, ALNUM)
    return powers.spans(powers.prefix(data), start, end), start, end, doc


def patterns_of(names: list[str], texts: list[bytes], width: int = WORDS) -> dict:
    """Plain-data search set of benchmark items: vocabulary (sorted word hashes), the
    items' words by number, distinct patterns as places in them, and the items of
    each pattern."""
    powers = Powers()
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    word, _, _, doc = split_words(data, off, powers)
    vocabulary, number = np.unique(word, return_inverse=True)
    count = per_row(doc, len(texts))
    h, first = windows(word, doc, width, 59)
    begin = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < width))    # an item of few words is one pattern
    one = np.zeros(len(short), U64)
    for j, salt in enumerate(salts(width, 61)[: width - 1]):
        there = count[short] > j
        one[there] += word[begin[short][there] + j] * salt
    h = np.r_[h, mix(one + count[short].astype(U64))]
    first = np.r_[first, begin[short]]
    length = np.minimum(count[doc[first]], width)
    _, sample, which = np.unique(h, return_index=True, return_inverse=True)
    owners = np.unique(np.c_[which, doc[first]], axis=0)     # an item owns a pattern once
    return {"vocabulary": vocabulary, "words": (number + 1).astype(np.int32), "first": first[sample], "lengths": length[sample],
            "owner_at": np.r_[0, np.cumsum(per_row(owners[:, 0], len(sample)))], "owners": owners[:, 1].astype(np.int32),
            "names": names}


def search_slice(search: dict, data, off, powers: Powers):
    """Per slice: (number of words per document, hit word ranges as (document,
    first word, end word), items found as (document, item))."""
    word, start, end, doc = split_words(data, off, powers)
    n_docs = len(off) - 1
    n_words = per_row(doc, n_docs)
    begin = np.cumsum(n_words) - n_words
    vocabulary = search["vocabulary"]
    at = np.minimum(np.searchsorted(vocabulary, word), max(len(vocabulary) - 1, 0))
    symbol = np.where(vocabulary[at] == word, at + 1, END) if len(vocabulary) else np.zeros(len(word), np.int64)
    # One terminator after each document; runs of terminators shrink to one.
    place = np.arange(len(word)) + doc
    seq = np.zeros(len(word) + n_docs, np.int64)
    seq[place] = symbol
    keep = np.r_[True, (seq[1:] != END) | (seq[:-1] != END)]
    keep[-1] = True
    source = np.full(len(seq), -1, np.int64)
    source[place] = np.arange(len(word))
    seq, source = seq[keep], source[keep]
    if seq[-1] != END or not seq.any() or not len(search["first"]):
        z = np.zeros(0, np.int64)
        return n_words, begin, (z, z, z), (z, z), (start, end)
    bits = int(len(vocabulary)).bit_length()
    index = FMIndex(seq, bits)
    lo, hi = index.search(search["words"], search["first"], search["lengths"])
    found = np.flatnonzero(hi > lo)
    times = (hi - lo)[found]
    pattern = np.repeat(found, times)
    rows = np.repeat(lo[found] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    first = source[index.locate(rows)] if len(rows) else rows
    length = search["lengths"][pattern]
    owner_at = search["owner_at"]
    many = owner_at[pattern + 1] - owner_at[pattern]
    item = search["owners"][np.repeat(owner_at[pattern] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
    hits = np.unique(np.c_[np.repeat(doc[first], many), item], axis=0) if len(rows) else np.zeros((0, 2), np.int64)
    return n_words, begin, (doc[first], first, first + length), (hits[:, 0], hits[:, 1]), (start, end)


def merged(first, end, n: int):
    """Merged ranges over ``n`` words: (first, end) of the maximal covered runs."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, first, 1)
    np.add.at(d, end, -1)
    inside = np.r_[False, np.cumsum(d[:-1]) > 0, False]
    return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])


def _merged_spans(search: dict, data, off, powers: Powers):
    """Per slice: (words per document, owner of each merged span, its first and end
    word, its first and end byte, items found as (document, item))."""
    n = len(off) - 1
    n_words, begin, (d, first, end), hits, (byte_start, byte_end) = search_slice(search, data, off, powers)
    # Ranges never cross documents, so one merge covers the slice; documents are kept
    # apart by one empty place each.
    a, b = merged(first + d, end + d, int(n_words.sum()) + n)
    owner = np.searchsorted(begin + np.arange(n), a, side="right") - 1
    a, b = a - owner - begin[owner], b - owner - begin[owner]
    w = begin[owner]
    return n_words, owner, (a, b), (byte_start[w + a] - off[owner], byte_end[w + b - 1] - off[owner]), hits


def _byte_spans(search: dict, data, off, powers: Powers) -> list[list[tuple[int, int]]]:
    _, owner, _, (first, end), _ = _merged_spans(search, data, off, powers)
    out: list[list] = [[] for _ in range(len(off) - 1)]
    for d, a, b in zip(owner.tolist(), first.tolist(), end.tolist()):
        out[d].append((a, b))
    return out


def _search_block(docs: DataFrame, shared, only_hits: bool = False) -> DataFrame:
    """(columns of ``docs`` but the text, n_words, spans as arrays, items) of one broadcast block."""
    kept = docs.drop("text")
    names = kept.columns

    def run(batches):
        import pyarrow as pa

        powers, s = Powers(), shared.value
        for batch in batches:
            for rows, data, off, _ in slices(batch):
                n = len(off) - 1
                n_words, owner, words, places, (hit_doc, item) = _merged_spans(s, data, off, powers)
                spans = np.bincount(owner, minlength=n)
                bounds = np.r_[0, np.cumsum(spans)].astype(np.int32)
                named = pa.array([s["names"][i] for i in item.tolist()], pa.string())
                item_bounds = np.r_[0, np.cumsum(np.bincount(hit_doc, minlength=n))].astype(np.int32)
                where = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int64)))
                         for x in (*words, *places)]
                out = pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in names), pa.array(n_words), *where,
                     pa.ListArray.from_arrays(pa.array(item_bounds), named)],
                    [*names, "n_words", "first_word", "end_word", "first_byte", "end_byte", "items"])
                yield out.filter(pa.array(spans > 0)) if only_hits else out

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    return docs.select(*names, "text").mapInArrow(
        run, ", ".join([*kinds, "n_words long, first_word array<long>, end_word array<long>, "
                                "first_byte array<long>, end_byte array<long>, items array<string>"]))


def _blocks(benchmark: DataFrame, block_bytes: int) -> DataFrame:
    """(block, search) of blocks of at most ``block_bytes`` of text (or one item), derived
    in tasks and written down; a small benchmark is one block."""
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Tasks fill their blocks on their own, so there are only as many tasks as whole blocks.
    items = items.repartition(max(1, min(int(total // block_bytes), benchmark.sparkSession.sparkContext.defaultParallelism)))

    def run(batches):
        import pickle

        import pyarrow as pa

        names, texts, size = [], [], 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(patterns_of(names, texts))], pa.binary())], ["search"])

        for batch in batches:
            for name, text in zip(batch.column("i").to_pylist(), batch.column("text").to_pylist()):
                raw = (text or "").encode()
                if names and size + len(raw) > block_bytes:
                    yield block()
                    names, texts, size = [], [], 0
                names.append(str(name))
                texts.append(raw)
                size += len(raw)
        if names:
            yield block()

    made = items.mapInArrow(run, "search binary")
    return cut(made.select(F.monotonically_increasing_id().alias("block"), "search"))


def _sent(blocks: DataFrame, names: list[int]):
    """The blocks one by one, each broadcast; before the next, the last one is given back."""
    import pickle

    for name in names:
        row = blocks.filter(F.col("block") == name).select("search").first()
        shared = blocks.sparkSession.sparkContext.broadcast(pickle.loads(row["search"]))
        yield shared
        shared.destroy()


def _names(blocks: DataFrame) -> list[int]:
    return [r["block"] for r in blocks.select("block").orderBy("block").collect()]


def _one_block(blocks: DataFrame, names: list[int], spark):
    """Broadcast of the only block, or of an empty search set."""
    import pickle

    search = pickle.loads(blocks.select("search").first()["search"]) if names else patterns_of([], [])
    return spark.sparkContext.broadcast(search)


def _find_by_key(keyed: DataFrame, blocks: DataFrame, names: list[int]) -> DataFrame:
    """(row_key_, spans, items) of the rows of ``keyed`` (row_key_, text) that a block hits."""
    span = F.arrays_zip("first_word", "end_word", "first_byte", "end_byte")
    every = None
    for shared in _sent(blocks, names):
        part = cut(_search_block(keyed, shared, only_hits=True).select("row_key_", span.alias("s"), "items"))
        every = part if every is None else every.unionByName(part)
    every = every.groupBy("row_key_").agg(F.flatten(F.collect_list("s")).alias("s"), F.flatten(F.collect_list("items")).alias("items"))
    kind = every.schema["s"].dataType.simpleString()
    joined = F.aggregate(
        F.array_sort("s"), F.expr(f"cast(array() as {kind})"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end_word"] >= x["first_word"]),
                               F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                                   F.element_at(done, -1)["first_word"].alias("first_word"),
                                   F.greatest(F.element_at(done, -1)["end_word"], x["end_word"]).alias("end_word"),
                                   F.element_at(done, -1)["first_byte"].alias("first_byte"),
                                   F.greatest(F.element_at(done, -1)["end_byte"], x["end_byte"]).alias("end_byte")))))
        .otherwise(F.concat(done, F.array(x))))
    return every.select("row_key_", joined.alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))


def find(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``spans`` (array of first/end word and byte, merged)
    and ``items`` (sorted ids of the benchmark items with occurring windows)."""
    blocks = _blocks(benchmark, block_bytes)
    names = _names(blocks)
    docs = docs.select("doc_id", "text")
    if len(names) <= 1:
        span = F.arrays_zip("first_word", "end_word", "first_byte", "end_byte")
        return _search_block(docs, _one_block(blocks, names, docs.sparkSession)).select(
            "doc_id", "n_words", span.alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))
    keyed = cut(docs.withColumn("row_key_", F.monotonically_increasing_id()))
    found = _find_by_key(keyed.select("row_key_", "text"), blocks, names)
    # An empty search set counts the words of all rows.
    counted = _search_block(keyed, docs.sparkSession.sparkContext.broadcast(patterns_of([], []))).select("row_key_", "doc_id", "n_words")
    none = [F.expr(f"cast(array() as {found.schema[c].dataType.simpleString()})") for c in ("spans", "items")]
    return counted.join(found, "row_key_", "left").select(
        "doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["first_word"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the contaminated spans cut out of the text and ``n_chars`` set
    anew; rows without a hit, null texts among them, are left as they are.  With
    several benchmark blocks the spans are found first and joined by a key per row."""
    blocks = _blocks(benchmark, block_bytes)
    keys = _names(blocks)
    names = docs.columns
    if len(keys) > 1:
        keyed = cut(docs.withColumn("row_key_", F.monotonically_increasing_id()))
        found = _find_by_key(keyed.select("row_key_", "text"), blocks, keys).select("row_key_", F.transform(
            "spans", lambda s: F.struct(s["first_byte"].alias("first_byte"), s["end_byte"].alias("end_byte"))).alias("spans_"))
        searched, shared = keyed.join(found, "row_key_", "left"), docs.sparkSession.sparkContext.broadcast(None)
    else:
        searched, shared = docs, _one_block(blocks, keys, docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        powers, search = Powers(), shared.value
        for batch in batches:
            for rows, data, off, null in slices(batch):
                if search is not None:
                    spans = _byte_spans(search, data, off, powers)
                else:
                    spans = [[(s["first_byte"], s["end_byte"]) for s in x or []] for x in rows.column("spans_").to_pylist()]
                texts, size = rows.column("text").to_pylist(), rows.column("n_chars").to_pylist() if "n_chars" in names else []
                for i, own in enumerate(spans):
                    if own:
                        raw, at, kept = texts[i].encode(), 0, []
                        for a, b in own:
                            kept.append(raw[at:a])
                            at = b
                        texts[i] = (b"".join(kept) + raw[at:]).decode()
                        if size:
                            size[i] = len(texts[i])
                made = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(size, pa.int64())}
                yield pa.RecordBatch.from_arrays([made[c] if c in made else rows.column(c) for c in names], names)

    kind = {"n_chars": "bigint"}
    out = ", ".join(f"`{f.name}` {kind.get(f.name, f.dataType.simpleString())}" for f in docs.schema)
    return searched.mapInArrow(run, out)


def items_sha256(items: list[str]) -> str:
    """The digest of a list of item ids, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
