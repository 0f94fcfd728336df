"""Hard negatives by inner product, searched in an STR-packed R-tree.

Vectors are integer (``quantised``); a row's score is its inner product with the anchor,
higher first, ties by smaller id.  Per anchor come its first ``POSITIVES`` other rows of the
same label, and per positive the first ``NEGATIVES`` rows of other labels whose score lies in
a window below the positive's (``mine``).

* Packing (``pages``).  Sort-tile-recursive: the ``TILED`` coordinates that vary most are
  cut at nested quantiles of a sample of at most ``SAMPLE`` rows (the first by a hash of the id);
  every row gets its tile, and Spark's range partitioning by (label, tile, next
  coordinate, id) lays the rows out, so that a tile or a vector with many rows spreads over
  tasks.  Runs of ``PAGE`` rows become pages, the subtrees: their rows are packed again into
  leaves of ``LEAF`` rows, and leaves and groups of ``FAN`` leaves have minimum bounding boxes.
* Search (``search``).  A box bounds each coordinate's product with an anchor, and the sum
  of the bounds is an interval for the scores in it: two matrix products for many
  anchors at once.  A task keeps the best rows so far per anchor and window and takes
  boxes from a queue, highest bound first; a box goes unread if for all anchors its interval
  misses their windows or ends strictly below their kth score.
* The anchors are the query set.  They are packed on the executors and sent in blocks of at
  most ``ANCHORS`` rows, one block a job; each task returns at most k rows per anchor and
  window, and ranks over the tasks give the result.

Rows with a null label, a null vector, or a null or non-finite component take no part.
Equal rows (id, label and vector) are one row; an anchor's other rows are all but itself.
A row without an id is never an anchor; among ties it comes last.  The components that
a shorter vector lacks are 0.  Scores are 64-bit integers.  Tables without rows give
none; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorecraft.llm.storage import cut

POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100           # window of a negative's score, in hundredths of the positive's
SAMPLE, TILED, SLABS = 8192, 3, 8
PAGE, LEAF, FAN = 1024, 32, 8
ANCHORS = 16_384              # of a block: at most 8 MB at 64 components
TOGETHER = 128                # anchors that share a queue
NO_ID = (1 << 63) - 1
LEAST = -(1 << 63)
FOUND = "anchor_id long, key long, low long, high long, id long, score long"


def quantised(vectors: DataFrame, label: Column | str = "label", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, vec, key) of the rows that take part: floor(scale * x) of every component x
    as double; ``key`` tells rows that share an id apart."""
    x = F.col(vector)
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.filter(whole).select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), label.cast("long").alias("label"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("vec"))
    return rows.filter("label IS NOT NULL").withColumn("key", F.xxhash64("id", "label", "vec"))


def matrix(column, rest: int = 0):
    """Arrow list column as an int64 matrix; short rows end in ``rest``."""
    size = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy()
    if len(size) and (size == size[0]).all():
        return flat.reshape(len(size), -1)
    out = np.full((len(size), int(size.max()) if len(size) else 0), rest, np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


class Tiles:
    """Nested quantile cuts of the coordinates that vary most in a sample."""

    def __init__(self, sample):
        self.dims = np.argsort(-sample.astype(float).var(axis=0), kind="stable")[: TILED + 1] if len(sample) else np.zeros(0, int)
        self.cuts: dict[tuple, np.ndarray] = {}
        self._cut(sample, ())

    def _cut(self, rows, path) -> None:
        if len(path) == min(TILED, len(self.dims)):
            return
        x = np.sort(rows[:, self.dims[len(path)]])
        cuts = x[[len(x) * i // SLABS for i in range(1, SLABS)]] if len(x) else np.zeros(0, np.int64)
        self.cuts[path] = cuts
        slab = np.searchsorted(cuts, rows[:, self.dims[len(path)]], side="right")
        for s in range(SLABS):
            self._cut(rows[slab == s], (*path, s))

    def of(self, x):
        """(tile, next coordinate) of each row."""
        tile, used = np.zeros(len(x), np.int64), self.dims
        x = np.pad(x, ((0, 0), (0, max(0, int(used.max(initial=-1)) + 1 - x.shape[1]))))
        for level in range(min(TILED, len(used))):
            slab = np.zeros(len(x), np.int64)
            for path, cuts in self.cuts.items():
                if len(path) == level:
                    number = int(sum(s * SLABS ** (level - 1 - i) for i, s in enumerate(path)))
                    mine = tile == number
                    slab[mine] = np.searchsorted(cuts, x[mine, self.dims[level]], side="right")
            tile = tile * SLABS + slab
        return tile, x[:, used[TILED]] if len(used) > TILED else np.zeros(len(x), np.int64)


def str_order(x, leaf: int = LEAF):
    """Order of the rows of a page by sort-tile-recursive packing."""
    dims = np.argsort(-x.astype(float).var(axis=0), kind="stable")[:TILED]

    def pack(rows, level):
        if level == len(dims) or len(rows) <= leaf:
            return [rows]
        slabs = max(1, round((-(-len(rows) // leaf)) ** (1 / (len(dims) - level))))
        width = -(-len(rows) // (slabs * leaf)) * leaf                # whole leaves
        rows = rows[np.argsort(x[rows, dims[level]], kind="stable")]
        return [r for i in range(0, len(rows), width) for r in pack(rows[i: i + width], level + 1)]

    return np.concatenate(pack(np.arange(len(x)), 0))


def boxes(x, size: int):
    """(low, high) corners of the runs of ``size`` rows."""
    at = np.arange(0, len(x), size)
    return np.minimum.reduceat(x, at, axis=0), np.maximum.reduceat(x, at, axis=0)


def pages(rows: DataFrame) -> DataFrame:
    """The packed tree: (width, ids, labels, vecs) per page, rows in leaf order."""
    picked = rows.orderBy(F.xxhash64("id"), "key").limit(SAMPLE).select("vec").toArrow()      # the bounded sample
    tiles = Tiles(matrix(picked["vec"].combine_chunks()))

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            tile, after = tiles.of(matrix(batch.column("vec")))
            yield batch.append_column("tile", pa.array(tile)).append_column("after", pa.array(after))

    def pack(batches):
        import pyarrow as pa

        def page(parts):
            width = max(p[2].shape[1] for p in parts)
            x = np.concatenate([np.pad(p[2], ((0, 0), (0, width - p[2].shape[1]))) for p in parts])
            ids, labels = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            order = str_order(x)
            return pa.RecordBatch.from_pydict({"width": [width], "ids": [ids[order]], "labels": [labels[order]],
                                               "vecs": [x[order].astype(np.int64).tobytes()]}, schema)

        schema = pa.schema([("width", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("vecs", pa.binary())])
        last, held, n = None, [], 0
        for batch in batches:
            ids, labels, keys = (batch.column(c).to_numpy() for c in ("id", "label", "key"))
            now = np.c_[ids, labels, keys]
            new = np.r_[True, (now[1:] != now[:-1]).any(axis=1)] if len(now) else np.zeros(0, bool)
            if len(now) and last is not None:
                new[0] = (now[0] != last).any()
            if len(now):
                last = now[-1]
            at, x = np.flatnonzero(new), matrix(batch.column("vec"))
            while len(at):
                take = at[: PAGE - n]
                held.append((ids[take], labels[take], x[take]))
                n, at = n + len(take), at[len(take):]
                if n == PAGE:
                    yield page(held)
                    held, n = [], 0
        if n:
            yield page(held)

    order = ["label", "tile", "after", "id", "key"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(deal, "id long, label long, vec array<long>, key long, tile long, after long")
    return dealt.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        pack, "width int, ids array<long>, labels array<long>, vecs binary")


def exact_kind(a, x):
    """A number type in which the inner products of both are exact (up to 64 bits)."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * max(x.shape[1], 1)
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


class Best:
    """The best ``k`` rows so far of every anchor and window."""

    def __init__(self, low, high, k: int):
        self.low, self.high = low, high                              # (anchors, windows)
        self.score = np.full((*low.shape, k), LEAST, np.int64)
        self.id = np.full((*low.shape, k), NO_ID, np.int64)

    def floor(self, at):
        return np.maximum(self.low[at], self.score[at, :, -1])

    def wants(self, at, least, most):
        """Which anchors can use a box whose scores lie in [least, most]."""
        return ((most[:, None] >= self.floor(at)) & (least[:, None] <= self.high[at])).any(axis=1)

    def add(self, at, scores, ids, allowed) -> None:
        floor, high = self.floor(at), self.high[at]
        for w in range(floor.shape[1]):
            good = allowed & (scores >= floor[:, w: w + 1]) & (scores <= high[:, w: w + 1])
            rows = np.flatnonzero(good.any(axis=1))
            if len(rows) == 0:
                continue
            mine = at[rows]
            s = np.hstack([self.score[mine, w], np.where(good[rows], scores[rows], LEAST)])
            i = np.hstack([self.id[mine, w], np.where(good[rows], ids[None, :], NO_ID)])
            first = np.lexsort((i, ~s), axis=1)[:, : self.score.shape[2]]
            self.score[mine, w] = np.take_along_axis(s, first, axis=1)
            self.id[mine, w] = np.take_along_axis(i, first, axis=1)


class Anchors:
    """A block of anchors: (id, key, label, vectors, windows)."""

    def __init__(self, blocks: list[dict]):
        width = max(b["vec"].shape[1] for b in blocks)
        self.id, self.key, self.label = (np.concatenate([b[c] for b in blocks]) for c in ("id", "key", "label"))
        self.vec = np.concatenate([np.pad(b["vec"], ((0, 0), (0, width - b["vec"].shape[1]))) for b in blocks])
        windows = max(b["low"].shape[1] for b in blocks)
        pad = lambda m, v: np.pad(m, ((0, 0), (0, windows - m.shape[1])), constant_values=v)
        self.low = np.concatenate([pad(b["low"], NO_ID) for b in blocks])
        self.high = np.concatenate([pad(b["high"], LEAST) for b in blocks])
        order = np.argsort(self.label, kind="stable")                # anchors of one label share queues
        for name in ("id", "key", "label", "vec", "low", "high"):
            setattr(self, name, getattr(self, name)[order])


def search_page(anchors: Anchors, at, best: Best, ids, labels, x, same: bool) -> None:
    """Best-first search of one page for the anchors ``at`` (an index array)."""
    width = min(x.shape[1], anchors.vec.shape[1])
    x, a = x[:, :width], anchors.vec[at, :width]
    kind = exact_kind(a, x)
    x, a = x.astype(kind), a.astype(kind)
    up, down = np.maximum(a, 0), np.minimum(a, 0)

    def intervals(size):
        lo, hi = boxes(x, size)
        return ((up @ lo.T + down @ hi.T).astype(np.int64), (up @ hi.T + down @ lo.T).astype(np.int64))

    queue, bounds = [], [intervals(LEAF * FAN), intervals(LEAF)]

    def push(level, box) -> None:
        least, most = bounds[level][0][:, box], bounds[level][1][:, box]
        want = best.wants(at, least, most)
        if want.any():
            heapq.heappush(queue, (-int(most[want].max()), level, box))

    for box in range(bounds[0][0].shape[1]):
        push(0, box)
    while queue:
        _, level, box = heapq.heappop(queue)
        want = np.flatnonzero(best.wants(at, bounds[level][0][:, box], bounds[level][1][:, box]))
        if len(want) == 0:
            continue
        if level == 0:
            for leaf in range(box * FAN, min((box + 1) * FAN, bounds[1][0].shape[1])):
                push(1, leaf)
            continue
        rows = slice(box * LEAF, (box + 1) * LEAF)
        scores, mine = (a[want] @ x[rows].T).astype(np.int64), at[want]
        allowed = (anchors.label[mine][:, None] == labels[rows][None, :]) == same
        i, j = np.nonzero(anchors.id[mine][:, None] == ids[rows][None, :])
        itself = allowed[i, j] & (anchors.label[mine[i]] == labels[rows][j]) & (a[want][i] == x[rows][j]).all(axis=1)
        allowed[i[itself], j[itself]] = False
        best.add(mine, scores, ids[rows], allowed)


def search(tree: DataFrame, anchors: Anchors, k: int, same: bool) -> DataFrame:
    """(anchor_id, key, low, high, id, score): per task the best rows of the same label
    (or of other labels) per anchor and window."""
    shared = tree.sparkSession.sparkContext.broadcast(anchors)

    def run(batches):
        import pyarrow as pa

        block = shared.value
        best = Best(block.low, block.high, k)
        for batch in batches:
            for width, ids, labels, vecs in zip(*(batch.column(c) for c in ("width", "ids", "labels", "vecs"))):
                ids, labels = ids.values.to_numpy(), labels.values.to_numpy()
                x = np.frombuffer(vecs.as_py(), np.int64).reshape(len(ids), width.as_py())
                if same:
                    wanted = np.flatnonzero(np.isin(block.label, np.unique(labels)))
                else:
                    wanted = np.flatnonzero(block.label != labels[0]) if (labels == labels[0]).all() else np.arange(len(block.label))
                for i in range(0, len(wanted), TOGETHER):
                    search_page(block, wanted[i: i + TOGETHER], best, ids, labels, x, same)
        a, w, r = np.nonzero(best.score > LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (block.id[a], block.key[a], block.low[a, w], block.high[a, w],
                                                               best.id[a, w, r], best.score[a, w, r])],
                                         ["anchor_id", "key", "low", "high", "id", "score"])

    return tree.mapInArrow(run, FOUND)


def in_blocks(tree: DataFrame, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """``search`` for all queries (id, key, label, vec, low, high), block after block, and
    the first k rows of every anchor and window over all tasks."""
    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, len(batch), ANCHORS // 8):
                part = batch.slice(i, ANCHORS // 8)
                row = {c: matrix(part.column(c), rest) for c, rest in (("vec", 0), ("low", NO_ID), ("high", LEAST))}   # no window
                yield pa.RecordBatch.from_pydict(
                    {"n": [len(part)], **{c: [part.column(c).to_numpy().tobytes()] for c in ("id", "key", "label")},
                     **{c: [np.ascontiguousarray(m).tobytes()] for c, m in row.items()}},
                    pa.schema([("n", pa.int32()), *[(c, pa.binary()) for c in ("id", "key", "label", "vec", "low", "high")]]))

    packed = cut(queries.select("id", "key", "label", "vec", "low", "high").mapInArrow(
        pack, "n int, id binary, key binary, label binary, vec binary, low binary, high binary"))
    found, held, n = None, [], 0

    def one_block():
        part = search(tree, Anchors(held), k, same)
        return cut(part if found is None else found.unionByName(part), instead_of=found)

    for row in packed.toLocalIterator():
        if held and n + row["n"] > ANCHORS:
            found, held, n = one_block(), [], 0
        block = {c: np.frombuffer(row[c], np.int64) for c in ("id", "key", "label")}
        block |= {c: np.frombuffer(row[c], np.int64).reshape(row["n"], -1) for c in ("vec", "low", "high")}
        held.append(block)
        n += row["n"]
    if held:
        found = one_block()
    if found is None:
        return tree.sparkSession.createDataFrame([], f"{FOUND}, rank int")
    order = Window.partitionBy("anchor_id", "key", "low", "high").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score, for ``rows`` of ``quantised`` and the anchors among them."""
    tree = cut(pages(rows))
    chosen = cut(rows.filter(is_anchor & (F.col("id") != NO_ID)).dropDuplicates(["id", "key"]))
    everything = chosen.withColumns({"low": F.array(F.lit(LEAST)), "high": F.array(F.lit(NO_ID))})
    best = in_blocks(tree, everything, positives, same=True)
    p = F.col("score")
    # low * p <= 100 * negative <= high * p in whole numbers: rounded up and down
    positive = cut(best.select("anchor_id", "key", F.col("id").alias("positive_id"), p.alias("positive_score"),
                               F.expr(f"(score * {low} + pmod(-score * {low}, 100)) div 100").alias("low"),
                               F.expr(f"(score * {high} - pmod(score * {high}, 100)) div 100").alias("high")))
    windows = (positive.filter("low <= high").select("anchor_id", "key", F.struct("low", "high").alias("w")).distinct()
               .groupBy("anchor_id", "key").agg(F.collect_list("w").alias("w"))
               .select(F.col("anchor_id").alias("id"), "key", F.col("w.low").alias("low"), F.col("w.high").alias("high")))
    found = in_blocks(tree, chosen.join(windows, ["id", "key"]), negatives, same=False).select(
        "anchor_id", "key", "low", "high", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return positive.join(found, ["anchor_id", "key", "low", "high"]).select(
        "anchor_id", back("positive_id"), "rank", back("negative_id"), "positive_score", "negative_score")


def brute_force(rows: list[tuple], is_anchor) -> list[tuple]:
    """The rows of ``mine`` for (id, label, integer vector) rows, for tests."""
    rows = sorted({(NO_ID if i is None else i, l, tuple(v)) for i, l, v in rows})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in rows:
        if a[0] == NO_ID or not is_anchor(a[0]):
            continue
        ranked = sorted(((-dot(a[2], r[2]), r[0], r[1]) for r in rows if r is not a))
        for p, pid, _ in [r for r in ranked if r[2] == a[1]][:POSITIVES]:
            fit = [r for r in ranked if r[2] != a[1] and LOW * -p <= 100 * -r[0] <= HIGH * -p][:NEGATIVES]
            out += [(a[0], None if pid == NO_ID else pid, rank, None if n[1] == NO_ID else n[1], -p, -n[0])
                    for rank, n in enumerate(fit, 1)]
    return sorted(out, key=str)
