"""Exact Jaccard join of documents on word shingles, as a metric-space join.

The Jaccard distance d = 1 - J is a metric, and documents link when
d <= r = 1 - ``NEAR``/100.  The join goes from coarse regions to fine ones:

1. Equal sets are one class; the row with the smallest key (of id and text) stands
   for it, whatever other texts its id has.
2. Size windows.  Against the set of all shingles as pivot the triangle
   inequality bounds the sizes of linked sets (each at least ``NEAR`` % of the
   other), so sets fall into size classes, and those near a border are
   replicated into the class below.
3. Far documents are all at distance 1, where no document can serve as pivot.
   Regions are therefore seeded by shared sets: in a size class the shingle
   universe is cut into more parts than linked sets have differences, so linked
   sets agree entirely on one of their largest parts (pigeonhole).  Sets that
   share such a part are joined into one region; no link leaves a region.
   Parts that meet in one slice of a task are joined there, and only one of
   them is shuffled, so a part of a third of all rows stays small.
4. A region is split by document pivots into Voronoi cells.  A cell pair is
   compared only within the windows that the triangle inequality leaves open
   (a document can have a partner in a cell of pivot q and radius R only if
   its distance to q is at most R + r); there all similarities are exact counts.
   Regions beyond ``REGION_DOCS`` or ``REGION_SHINGLES`` are split by pivots on
   Spark first, boundary documents being replicated, again and again for as long as the
   cells shrink (``SHRUNK``, ``SPREAD``); a region that pivots do not separate is joined in
   blocks, pair by pair.
5. Links of regions that were split meet in connected components of classes.  Only
   then come ids: classes of one id are united, and the smallest id names them.

Null texts and texts without words have an empty set and link with nothing.
Rows that share an id count as one document for linking.  Rows without an id get the
smallest component of any of them, but unite no others.  Shingles and sets
are compared by 64- and 128-bit hashes.  ``doc_id`` is an integer or null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorecraft.llm.batches import BASE, SPACED, U64, Powers, lean, lower_ascii, mix, per_row, runs, salts, slices, windows
from scorecraft.llm.components import components
from scorecraft.llm.storage import cut, hold, let_go, settled
from scorecraft.llm.stored import NO_ID, packed_texts, row_key, unpacked

WORDS = 3
SMALL = 40                    # shingles up to which a set is indexed by single shingles
NEAR = 90                     # linked: 100 * intersection >= NEAR * union
REGION_DOCS, REGION_SHINGLES = 16_384, 6_000_000
RANGES = 16                   # of hash values in which a region's sets are compared; a power of two
CELL = 512                    # documents of a cell that are compared directly
PIVOTS = 16                   # of a region that is split on Spark
SHRUNK, SPREAD = 0.75, 4       # a split counts if no cell holds more than this share, all cells no more than this many times


def shingle_sets(data, off, powers: Powers, words: int = WORDS):
    """Distinct shingles of a slice of documents: (sorted hashes, offsets per document)."""
    n = len(off) - 1
    data = lower_ascii(data)
    start, end, doc = runs(data, off, SPACED)
    word = powers.spans(powers.prefix(data), start, end)
    h, first = windows(word, doc, words, 31)
    owner = doc[first]
    count = per_row(doc, n)
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):                                           # the whole sequence as one shingle
        begin = (np.cumsum(count) - count)[short]
        s = salts(words, 37)
        one = np.zeros(len(short), U64)
        for j in range(words - 1):
            there = count[short] > j
            one[there] += word[begin[there] + j] * s[j]
        h, owner = np.r_[h, mix(one + count[short].astype(U64))], np.r_[owner, short]
    order = np.argsort(h)
    order = order[np.argsort(owner[order].astype(np.uint16) if n < 1 << 16 else owner[order], kind="stable")]
    h, owner = h[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.zeros(0, bool)
    h, owner = h[new], owner[new]
    return h, np.r_[0, np.cumsum(per_row(owner, n))]


def size_classes(near: int, most: int = 1 << 40) -> np.ndarray:
    """First sizes of the size classes: the small sets up to ``SMALL``, then classes that
    grow by half; sets too small to differ have none."""
    first = [-(-near // (100 - near)), SMALL + 1]
    while first[-1] < most:
        first.append(first[-1] * 3 // 2 + 1)
    return np.array(first, np.int64)


def signatures(h, off, near: int, seed: int):
    """Part signatures of the sets of a slice: (values, offsets per set, any set
    that has too few parts for this seed)."""
    n, size = len(off) - 1, np.diff(off)
    borders = size_classes(near)
    own = np.searchsorted(borders, size, side="right") - 1
    doc_out, sig_out, short = [], [], False
    for c in np.unique(own[own >= 0]).tolist():
        for at in (c, c - 1):
            if at < 0:
                continue
            top = int(borders[at + 1]) - 1
            docs = np.flatnonzero(own == c) if at == c else np.flatnonzero((own == c) & (size * near <= top * 100))
            if len(docs) == 0:
                continue
            parts = (top * (100 - near) // near) * 13 // 10 + 8
            i = np.repeat(np.arange(len(docs)), size[docs])
            if at == 0:
                # Small sets: of the shingles in hash order, linked sets share one among the first
                # size - ceil(size * near / 100) + 1 of each.
                first = size[docs] - -(-size[docs] * near // 100) + 1
                nth = np.arange(len(i)) - np.repeat(np.cumsum(size[docs]) - size[docs], size[docs])
                keep = nth < first[i]
                sig_out.append(mix(h[(off[docs][i] + nth)[keep]] ^ salts(1, 53)[0]))
                doc_out.append(docs[i[keep]])
                continue
            x = h[np.repeat(off[docs] - (np.cumsum(size[docs]) - size[docs]), size[docs]) + np.arange(len(i))]
            salt = U64((seed * 1009 + at) * int(BASE) % (1 << 64))
            part = ((mix(x ^ salt) >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
            cell = i * parts + part
            total = len(docs) * parts
            held = np.bincount(cell, minlength=total).reshape(len(docs), parts)
            y = mix(x ^ BASE)
            low = np.bincount(cell, weights=(y & U64(0xFFFFFFFF)).astype(float), minlength=total)
            high = np.bincount(cell, weights=(y >> U64(32)).astype(float), minlength=total)
            needed = size[docs] * (100 - near) // near                  # differences a link can have
            least = np.take_along_axis(-np.sort(-held, axis=1), np.minimum(needed, parts - 1)[:, None], axis=1)
            short |= bool((least == 0).any())
            d, b = np.nonzero((held >= least) & (held > 0))
            flat = d * parts + b
            key = low[flat].astype(U64) + high[flat].astype(U64) * salts(1, 41)[0]
            sig_out.append(mix(key ^ mix((b + parts * 64 + at).astype(U64) * BASE + held.ravel()[flat].astype(U64))))
            doc_out.append(docs[d])
    doc = np.concatenate(doc_out) if doc_out else np.zeros(0, np.int64)
    sig = np.concatenate(sig_out) if sig_out else np.zeros(0, U64)
    order = np.argsort(doc, kind="stable")
    return sig[order], np.r_[0, np.cumsum(per_row(doc, n))], short


def _keyed(docs: DataFrame) -> DataFrame:
    """(k, id, text): the rows of ``docs`` with their row keys and ids (``NO_ID`` for null)."""
    return docs.select(row_key().alias("k"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")


def _hashed(batches, words: int):
    """Per slice of the rows of ``_keyed``: (rows, shingles, offsets per row, two order-free
    64-bit hashes of each row's set)."""
    powers = Powers()
    for batch in batches:
        for rows, data, off, _ in slices(batch):
            h, bounds = shingle_sets(data, off, powers, words)
            keys = []
            for s in (43, 47):
                total = np.r_[U64(0), np.cumsum(mix(h ^ salts(1, s)[0]))]
                keys.append(mix(total[bounds[1:]] - total[bounds[:-1]]))
            yield rows, h, bounds, keys


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """Per row of ``docs`` (k, id, n, key1, key2); ``key1`` names the set in the graph of shared parts."""
    def run(batches):
        import pyarrow as pa

        for rows, _, bounds, keys in _hashed(batches, words):
            yield pa.RecordBatch.from_arrays(
                [rows.column("k"), rows.column("id"), pa.array(np.diff(bounds)), *[pa.array(x.view(np.int64)) for x in keys]],
                ["k", "id", "n", "key1", "key2"])

    return _keyed(docs).mapInArrow(lean(run), "k long, id long, n long, key1 long, key2 long")


def slice_parts(sig, ends, node):
    """(set, part) of a slice with each part once.  Sets that hold a part of an earlier set of the
    slice get one part in common with that set, however many they share."""
    doc = np.repeat(np.arange(len(node)), np.diff(ends))
    _, first, which = np.unique(sig, return_index=True, return_inverse=True)
    again = first[which] != np.arange(len(sig))
    a, b = node[doc[again]], node[doc[first[which[again]]]]
    a, b = np.unique(np.c_[a, b][a != b], axis=0).T
    link = mix(mix(a ^ salts(1, 59)[0]) ^ b)
    return np.r_[node[doc[~again]], a, b], np.r_[sig[~again], link, link]


def _parts(docs: DataFrame, words: int, near: int, seed: int) -> DataFrame:
    """(a, sig): the parts of all sets, ``a`` being the set's ``key1``; (0, null) for a slice where
    those of this seed are too few.  They are many times what ``_sets`` gives and needed once, so
    they are made from the texts again and not kept."""
    def run(batches):
        import pyarrow as pa

        for _, h, bounds, keys in _hashed(batches, words):
            sig, ends, short = signatures(h, bounds, near, seed)
            if short:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([None], pa.int64())], ["a", "sig"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.view(np.int64)) for x in slice_parts(sig, ends, keys[0])], ["a", "sig"])

    return _keyed(docs).mapInArrow(lean(run), "a long, sig long")


def intersections(a: list, b: list):
    """Matrix of intersection sizes between two lists of sorted distinct arrays."""
    out = np.zeros((len(a), len(b)), np.float32)
    if not a or not b:
        return out
    ha, hb = np.concatenate(a), np.concatenate(b)
    ia, ib = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    both = np.intersect1d(ha, hb)
    if len(both) == 0:
        return out
    ca, cb = (np.minimum(np.searchsorted(both, x), len(both) - 1) for x in (ha, hb))
    ka, kb = both[ca] == ha, both[cb] == hb
    ia, ca, ib, cb = ia[ka], ca[ka], ib[kb], cb[kb]
    width = max(1, 4_000_000 // (len(a) + len(b)))
    for lo in range(0, len(both), width):
        ma = np.zeros((len(a), min(width, len(both) - lo)), np.float32)
        mb = np.zeros((len(b), ma.shape[1]), np.float32)
        for m, i, c in ((ma, ia, ca), (mb, ib, cb)):
            s = (c >= lo) & (c < lo + width)
            m[i[s], c[s] - lo] = 1
        out += ma @ mb.T
    return out


def distances(a: list, b: list, size_a=None, size_b=None):
    """(distances, intersection sizes, union sizes); the sizes of the sets are given
    where the arrays hold only what sets share."""
    size_a, size_b = (np.array([len(s) for s in x]) if n is None else n for x, n in ((a, size_a), (b, size_b)))
    both = intersections(a, b).astype(float)
    union = size_a[:, None] + size_b[None, :] - both
    return 1 - both / np.maximum(union, 1), both, union


def shared_parts(sets: list) -> list:
    """The sets without the elements that one set alone holds.  The hashes are compared in
    ``RANGES`` ranges of values, one after the other, so that a region needs little more
    memory than its elements; the new names keep the order of the hashes."""
    if not sets:
        return []
    every, size = np.concatenate(sets), [len(s) for s in sets]
    name, used = np.full(len(every), -1, np.int32), 0
    part = (every >> U64(64 - RANGES.bit_length() + 1)).astype(np.uint8)
    for i in range(RANGES):
        at = np.flatnonzero(part == i)
        _, which, count = np.unique(every[at], return_inverse=True, return_counts=True)
        keep = count[which] > 1
        name[at[keep]] = which[keep] + used
        used += len(count)
    keep = name >= 0
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)[keep]
    return np.split(name[keep].astype(np.int64), np.cumsum(np.bincount(owner, minlength=len(sets)))[:-1])


class Union:
    """Disjoint sets over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)

    def roots(self):
        up = self.up
        while True:
            nxt = up[up]
            if (nxt == up).all():
                return up
            up = nxt


def _link(sets, size, union: Union, a, b, near: int) -> None:
    """Join all linked pairs between index arrays ``a`` and ``b``."""
    roots = union.roots()
    if len(np.unique(roots[np.r_[a, b]])) == 1:
        return                                               # nothing left to learn
    _, both, total = distances([sets[i] for i in a], [sets[i] for i in b], size[a], size[b])
    i, j = np.nonzero(100 * both >= near * total)
    ra, rb = roots[a[i]], roots[b[j]]
    pairs = np.unique(np.c_[np.minimum(ra, rb), np.maximum(ra, rb)], axis=0)
    for x, y in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
        union.join(x, y)


def join_region(sets: list, near: int = NEAR, cell: int = CELL):
    """Root of every set's component within one region of bounded size."""
    n, size = len(sets), np.array([len(s) for s in sets])
    union = Union(n)
    sets = shared_parts(sets)                                # unrelated documents shrink to next to nothing
    if n <= cell:
        _link(sets, size, union, np.arange(n), np.arange(n), near)
        return union.roots()
    r = 1 - near / 100 + 1e-9
    # Pivots far from each other first, so that cells are tight.
    count = min(64, -(-n // (cell // 2)))
    pivots, far = [0], None
    for _ in range(count):
        d = distances(sets, [sets[pivots[-1]]], size, size[pivots[-1:]])[0][:, 0]
        far = d if far is None else np.minimum(far, d)
        if far.max() == 0 or len(pivots) == count:
            break
        pivots.append(int(far.argmax()))
    to = np.concatenate([distances(sets[i: i + 1024], [sets[p] for p in pivots], size[i: i + 1024], size[pivots])[0]
                         for i in range(0, n, 1024)])
    home = to.argmin(axis=1)
    cells = [c[i: i + cell] for p in range(len(pivots)) for c in [np.flatnonzero(home == p)] for i in range(0, len(c), cell)]
    cells = [c for c in cells if len(c)]
    centre = [int(home[c[0]]) for c in cells]
    radius = [float(to[c, p].max()) for c, p in zip(cells, centre)]
    for x in range(len(cells)):
        _link(sets, size, union, cells[x], cells[x], near)
    for x in range(len(cells)):
        for y in range(x + 1, len(cells)):
            a = cells[x][to[cells[x], centre[y]] <= radius[y] + r]
            b = cells[y][to[cells[y], centre[x]] <= radius[x] + r]
            if len(a) and len(b):
                _link(sets, size, union, a, b, near)
    return union.roots()


def _grouped(batches, column: str):
    """Texts of consecutive rows with equal ``column``: (k array, list of bytes, value)."""
    import zstandard

    press, ks, zs, now = zstandard.ZstdDecompressor(), [], [], None
    for batch in batches:
        values = batch.column(column).to_pylist()
        for g, k, z in zip(values, batch.column("k").to_pylist(), batch.column("z")):
            if ks and g != now:
                yield np.array(ks), [press.decompress(x) for x in zs], now
                ks, zs = [], []
            now = g
            ks.append(k)
            zs.append(z.as_py())
    if ks:
        yield np.array(ks), [press.decompress(x) for x in zs], now


def _as_sets(texts: list[bytes], powers: Powers, words: int) -> list:
    out = []
    for i in range(0, len(texts), 256):
        part = texts[i: i + 256]
        off = np.r_[0, np.cumsum([len(t) for t in part])].astype(np.int64)
        h, bounds = shingle_sets(np.frombuffer(b"".join(part), np.uint8), off, powers, words)
        out += [h[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    return out


def _local_links(members: DataFrame, words: int, near: int) -> DataFrame:
    """Edges (a, b) from each member of a region to the smallest id of its local component."""
    def run(batches):
        import pyarrow as pa

        powers = Powers()
        for k, texts, _ in _grouped(batches, "region"):
            order = np.argsort(k, kind="stable")
            k = k[order]
            roots = join_region(_as_sets([texts[i] for i in order.tolist()], powers, words), near)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(k[roots])], ["a", "b"])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (members.select("region", "k", "z").repartition(n, "region").sortWithinPartitions("region")
            .mapInArrow(lean(run), "a long, b long"))


def _voronoi(members: DataFrame, seed: int, words: int, near: int) -> DataFrame:
    """Members of large regions dealt to the cells of sampled pivots.  A member goes
    to its nearest pivot and, as a visitor, to all within d + 2r: nothing nearer
    than r to it can be at home elsewhere."""
    # About twice as many candidates as pivots, by a hash, and the first of them.
    order = F.pmod(F.xxhash64(F.lit(seed), "k"), F.lit(1 << 40))
    pivots = (members.filter(order * F.col("docs") < F.lit(2.0 * PIVOTS * (1 << 40)))
              .withColumn("i", F.row_number().over(Window.partitionBy("region").orderBy(order, "k")))
              .filter(F.col("i") <= PIVOTS).groupBy("region").agg(F.collect_list("z").alias("pivots")))
    reach = 2 * (1 - near / 100) + 1e-9

    def run(batches):
        import pyarrow as pa

        powers, known = Powers(), {}
        for batch in batches:
            regions = batch.column("region").to_pylist()
            for lo in range(0, len(regions), 512):
                part = batch.slice(lo, 512)
                k = np.array(part.column("k").to_pylist())
                _, texts, _ = next(_grouped([part.append_column("all", pa.nulls(len(part)))], "all"))
                sets = _as_sets(texts, powers, words)
                names = regions[lo: lo + 512]
                for region in dict.fromkeys(names):
                    at = [i for i, g in enumerate(names) if g == region]
                    if region not in known:
                        import zstandard

                        press = zstandard.ZstdDecompressor()
                        raw = [press.decompress(z) for z in part.column("pivots")[at[0]].as_py()]
                        known = {region: _as_sets(sorted(raw), powers, words)}
                    d = distances([sets[i] for i in at], known[region])[0]
                    i, p = np.nonzero(d <= d.min(axis=1, keepdims=True) + reach)
                    i = np.array(at)[i]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{region}/{j}" for j in p.tolist()]), pa.array(k[i]),
                         part.column("n").take(pa.array(i)), part.column("z").take(pa.array(i)), pa.array([region] * len(i))],
                        ["region", "k", "n", "z", "parent"])

    return (members.join(pivots, "region").select("region", "k", "n", "z", "pivots")
            .mapInArrow(lean(run), "region string, k long, n long, z binary, parent string"))


def _blocks(members: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Members of regions that pivots do not separate, replicated to pairs of blocks."""
    wide = members.join(sizes.select("region", F.ceil(F.greatest(
        F.col("docs") * 2 / block, F.col("shingles") * 2 / REGION_SHINGLES)).cast("int").alias("blocks")), "region")
    own = F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                       lambda j: F.concat_ws(":", "region", F.least(j, own), F.greatest(j, own)))
    return wide.select(F.explode(pair).alias("region"), "k", "n", "z")


def _region_links(members: DataFrame, words: int, near: int, most_docs: int, most_shingles: int) -> DataFrame:
    """Edges of all regions (region string, k, n, z), large ones split first."""
    found, seed = None, 0
    while True:
        sizes = members.groupBy("region").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
        large = cut(sizes.filter((F.col("docs") > most_docs) | (F.col("shingles") > most_shingles)))
        if large.isEmpty():
            links = _local_links(members, words, near)
            return links if found is None else found.unionByName(links)
        small = members.join(large.select("region"), "region", "left_anti")
        links = _local_links(small, words, near)
        found = links if found is None else found.unionByName(links)
        members = members.join(large, "region")
        cells = cut(_voronoi(members, seed, words, near))
        held = cells.groupBy("parent", "region").agg(F.count("*").alias("c")).groupBy("parent").agg(
            F.max("c").alias("most"), F.sum("c").alias("all"))
        split = cut(held.join(large.withColumnRenamed("region", "parent"), "parent")
                    .filter((F.col("most") <= SHRUNK * F.col("docs")) & (F.col("all") <= SPREAD * F.col("docs"))).select("parent"))
        stuck = members.join(split.withColumnRenamed("parent", "region"), "region", "left_anti").drop("docs", "shingles")
        found = found.unionByName(_local_links(_blocks(stuck, large, most_docs), words, near))
        members = cells.join(split, "parent", "left_semi").drop("parent")
        seed += 1


KEYS = ["key1", "key2", "n"]   # of a set


def _packed(docs: DataFrame, **carried) -> DataFrame:
    """The texts of ``docs`` by row key, with the columns ``carried``."""
    own = docs.select("text", "doc_id", *[c.alias(name) for name, c in carried.items()])
    return packed_texts(own, *carried, key=row_key())


def linked_sets(docs: DataFrame, words: int = WORDS, near: int = NEAR, most_docs: int = REGION_DOCS,
                most_shingles: int = REGION_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """(sets: a row per row of ``docs`` with k, id and the keys of its set; classes: a row per
    set that is not empty with its smallest id ``low`` and its component ``c`` by links alone).

    What is large -- all parts, then the texts of regions by row key, then by region -- is on disk
    one after the other: each is written down as something smaller before the next is made."""
    sets = hold(_sets(docs, words))
    classes = cut(sets.filter("n > 0").groupBy(*KEYS).agg(F.min("k").alias("rep"), F.min("id").alias("low")))
    seed = 0
    while True:
        # Nearly all parts are alone, so nothing is counted before the shuffle; the parts move once.
        met = _parts(docs, words, near, seed).select(
            "a", F.min("a").over(Window.partitionBy("sig")).alias("b"), F.col("sig").isNull().alias("short"))
        edges = cut(met.filter("short OR a <> b").distinct())
        if edges.filter("short").isEmpty():                  # else the parts of another seed
            break
        let_go(edges)
        seed += 1
    regions = components(edges)
    let_go(edges)
    inside = (classes.join(regions.withColumnRenamed("node", "key1"), "key1")
              .select(F.col("rep").alias("k"), F.col("component").cast("string").alias("region"), "n"))
    members = cut(_packed(docs).join(inside, "k").select("region", "k", "n", "z").dropDuplicates(["k"]))  # one text per class
    links = cut(components(_region_links(members, words, near, most_docs, most_shingles)))
    let_go(members)
    linked = (classes.join(links.withColumnRenamed("node", "rep"), "rep", "left")
              .select(*KEYS, "low", F.coalesce("component", "rep").alias("c")))
    return sets, linked


def link(docs: DataFrame, words: int = WORDS, near: int = NEAR, most_docs: int = REGION_DOCS,
         most_shingles: int = REGION_SHINGLES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    keys = KEYS
    sets, linked = linked_sets(docs, words, near, most_docs, most_shingles)
    linked = _united(sets, linked, keys)
    lead = linked.groupBy("c").agg(F.min("low").alias("lead"))
    out = sets.select("id", *keys).join(linked.join(lead, "c").select(*keys, "lead"), keys, "left")
    by_id = out.groupBy("id").agg(F.min("lead").alias("component_id"))  # rows of one id are one document
    same = out.select("id", "n").join(by_id, "id")
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return same.select(back("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                       F.coalesce(back("component_id"), back("id")).alias("component_id"))


def _united(sets: DataFrame, linked: DataFrame, keys: list[str]) -> DataFrame:
    """``linked`` (keys, low, c) with the components of all classes of one id united."""
    own, key = sets.filter((F.col("n") > 0) & (F.col("id") != NO_ID)).select("id", *keys), F.struct(*keys)
    several = cut(own.groupBy("id").agg(F.min(key).alias("a"), F.max(key).alias("b")).filter("a <> b").select("id"))
    if several.isEmpty():
        return linked
    held = own.join(several, "id").join(linked.select(*keys, "c"), keys).select("id", F.col("c").alias("a"))
    met = held.join(held.groupBy("id").agg(F.min("a").alias("b")), "id").select("a", "b")
    joined = components(met)
    return (linked.join(joined.withColumnRenamed("node", "c"), "c", "left")
            .select(*keys, "low", F.coalesce("component", "c").alias("c")))


def _kept_rows(docs: DataFrame, words: int, near: int) -> DataFrame:
    """The rows that ``one_of_each`` keeps: k, the number ``rows_`` of rows with that key (null
    for rows without an id), the compressed text, whether it is null, and the columns of ``docs``
    by number."""
    other = {f"c{i}_": F.col(f"`{c}`") for i, c in enumerate(docs.columns) if c != "text"}
    sets, linked = linked_sets(docs, words, near)
    rows = hold(sets.filter(F.col("id") != NO_ID).join(linked.select(*KEYS, "c"), KEYS, "left").select("k", "id", "c"))
    lead = rows.groupBy(F.coalesce("c", "k").alias("c")).agg(F.min(F.struct("id", "k")).alias("one")).select("one.k")
    times = rows.join(lead, "k", "left_semi").groupBy("k").agg(F.count("*").alias("rows_"))
    packed = _packed(docs, null_=F.col("text").isNull(), named_=F.col("doc_id").isNotNull(), **other)
    return (packed.join(times, "k", "left").filter("NOT named_ OR rows_ IS NOT NULL")
            .select("k", F.when(F.col("named_"), F.col("rows_")).alias("rows_"), "z", "null_", *other))


def _unpacked_rows(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of ``_kept_rows`` as ``row_k_`` and the columns of ``docs``."""
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for rows, data, off in unpacked(batch):
                raw, null = memoryview(data), rows.column("null_").to_pylist()
                texts = pa.array([None if gone else raw[a:b].tobytes() for gone, a, b in
                                  zip(null, off[:-1].tolist(), off[1:].tolist())], pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("k"), *[texts if c == "text" else rows.column(f"c{i}_") for i, c in enumerate(names)]],
                    ["row_k_", *names])

    fields = [T.StructField(f.name, f.dataType) for f in docs.schema]
    return kept.drop("rows_").mapInArrow(lean(run), T.StructType([T.StructField("row_k_", T.LongType()), *fields]))


def one_of_each(docs: DataFrame, words: int = WORDS, near: int = NEAR) -> DataFrame:
    """``docs`` with one row of each component of linked texts: that of the smallest id, among
    rows of one id that of the smallest hash of the text, among rows equal in both the first
    by a hash of all columns.  Texts that link with nothing all stay, also if they share
    an id.  Rows without an id cannot be told apart by it and stay."""
    kept = settled(lambda: _kept_rows(docs, words, near))    # what follows has a short plan and needs nothing that was held
    once = _unpacked_rows(kept.filter("rows_ IS NULL OR rows_ = 1"), docs).drop("row_k_")
    again = _unpacked_rows(kept.filter("rows_ > 1"), docs)   # one row per key is left of these before any moves
    whole = F.struct(*docs.columns)
    first = again.groupBy("row_k_").agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("row_")).select("row_.*")
    return once.unionByName(first)


def brute_force(texts: dict[int, str | None], words: int = WORDS, near: int = NEAR) -> dict[int, tuple]:
    """doc_id -> (n_shingles, component_id), for tests."""
    import re

    sets = {}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j: j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= near * len(sets[i] | sets[j]):
                    low = min(comp[i], comp[j])
                    changed |= comp[i] != low or comp[j] != low
                    comp[i] = comp[j] = low
    return {i: (len(sets[i]), comp[i]) for i in sets}
