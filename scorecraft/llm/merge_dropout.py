"""Subword encoding with seeded merge-dropout, and lossless decoding.

The vocabulary is that of a public byte-fallback BPE model (its pieces and their
scores); nothing is trained.  A text is written with U+2581 for spaces and cut
into units at places that no piece can cross.  Per unit the candidate merges
wait in an agenda (best score first, then leftmost).  A candidate that is taken
out is skipped when a keyed hash of (seed, doc_id, unit, place of the unit in the
document, place, piece) falls below the dropout rate, otherwise the two symbols
merge and new neighbours join the agenda.  So every occurrence of a unit has
coins of its own, but every run repeats itself exactly; rate 0 gives the model's
own segmentation.

An agenda only depends on the coins of the candidates it meets.  Distinct
units are first worked on without coins; an occurrence that skips none
of the candidates met there has that segmentation.  The others are grouped by
unit and skipped candidates, one of each group runs its agenda with its own
coins, and those that agree with it on every candidate met share the result;
what is left is grouped anew.  A task keeps these results for its next slices
(``Book``).  Agendas of a round advance together, one
step at a time (``_agendas``); long units and those with byte pieces use a heap
(``unit``).  Both take the same steps.  Characters outside
the vocabulary, and literal U+2581, become byte pieces, so decoding restores
every text.

Null texts give null pieces; empty texts none.  Repeated rows give equal pieces.
Other columns are not read by ``encode`` and are passed through by ``with_pieces``.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from scorecraft.llm.batches import BASE, U64, Powers, byte_class, lean, mix, per_row, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RATE = 0.1
SEED = 17
SLICE = 1 << 20               # bytes of text; a worker holds some dozens of bytes for each
CHUNK = 1 << 15               # units whose agendas advance together, or whose coins are thrown together
BOOK = 1 << 23                # candidates that a task's book of segmentations holds between slices (64 MB)
LONG = 48                     # characters beyond which a unit uses the heap
SPACE = "\u2581"
NEVER = np.int32(1 << 30)     # rank of a pair that does not merge
LONE = "\n"                   # characters that the vocabulary has only alone or not at all


def vocabulary(model: str = MODEL) -> dict:
    """Plain-data vocabulary: piece names -> index, ids and scores, byte ids, the
    bytes of every id, and all merges (left, right) -> piece, sorted by key."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    names, ids, scores, bytes_, values = [], [], [], [0] * 256, []
    for i in range(sp.get_piece_size()):
        name = sp.id_to_piece(i)
        if sp.is_byte(i):
            bytes_[int(name[3:5], 16)] = i
            values.append(bytes([int(name[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            values.append(b"")
        else:
            names.append(name)
            ids.append(i)
            scores.append(sp.get_score(i))
            values.append(name.replace(SPACE, " ").encode())
    index = {n: i for i, n in enumerate(names)}
    if any(SPACE in n.lstrip(SPACE) or (len(n) > 1 and set(n) & set(LONE)) for n in names):
        raise ValueError("the vocabulary has pieces that cross the borders of units")
    merges = sorted((index[n[:k]] * len(names) + index[n[k:]], index[n])
                    for n in names for k in range(1, len(n)) if n[:k] in index and n[k:] in index)
    rank = np.unique(-np.array(scores, np.float64), return_inverse=True)[1].astype(np.int32)
    return {"names": names, "ids": np.array(ids, np.int32), "rank": rank, "bytes": bytes_, "values": values,
            "keys": np.array([m[0] for m in merges], np.int64), "merged": np.array([m[1] for m in merges], np.int32)}


def by_unit(parts, n: int, kind):
    """Values given as (unit of each, values), in the order of units: (flat values,
    start of each unit, size of each unit)."""
    unit = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    flat = np.concatenate([p[1] for p in parts]).astype(kind) if parts else np.zeros(0, kind)
    count = per_row(unit, n)
    return flat[np.argsort(unit, kind="stable")], np.cumsum(count) - count, count


def number_of(doc_id) -> int:
    """64 bits that stand for an id: an integer modulo 2**64, the hash of another id's text."""
    if doc_id is None:
        return (1 << 64) - 1
    return doc_id % (1 << 64) if isinstance(doc_id, int) else xxhash.xxh3_64_intdigest(str(doc_id))


class Merges:
    """Piece made by two symbols: a table of pair keys, each at the first free place from its
    hash on, with at least four times as many places as pairs."""

    def __init__(self, keys, pieces):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.last = U64(64 - bits), (1 << bits) - 1
        self.key, self.piece = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = self.key[at] < 0
            places, first = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.key[places], self.piece[places] = keys[left[chosen]], pieces[left[chosen]]
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left, at = left[rest], (at[rest] + 1) & self.last

    def _place(self, keys):
        return ((keys.astype(U64) * BASE) >> self.shift).astype(np.int64)

    def find(self, wanted):
        """(piece, whether there is one) of pair keys, which are not negative."""
        at = self._place(wanted)
        key = self.key[at]
        piece, ok = self.piece[at], key == wanted
        i = np.nonzero((key >= 0) & ~ok)
        while len(i[0]):
            next_ = (at[i] + 1) & self.last
            at[i] = next_
            hit = self.key[next_] == wanted[i]
            piece[i], ok[i] = self.piece[next_], hit
            more = (self.key[next_] >= 0) & ~hit
            i = tuple(x[more] for x in i)
        return piece, ok


class Growing:
    """An array that is appended to."""

    def __init__(self, kind):
        self.held, self.n = np.zeros(1 << 12, kind), 0

    def append(self, values) -> None:
        if self.n + len(values) > len(self.held):
            wider = np.zeros(max(2 * len(self.held), self.n + len(values)), self.held.dtype)
            wider[: self.n] = self.held[: self.n]
            self.held = wider
        self.held[self.n: self.n + len(values)] = values
        self.n += len(values)

    def all(self) -> np.ndarray:
        return self.held[: self.n]


class Book:
    """Segmentations made by a task, for the slices to come.  An entry has the pieces of a
    unit, the candidates met on the way and the sum of the names of those skipped; it holds for
    every occurrence whose coins skip just these.  A book beyond ``most`` candidates is begun
    anew between slices: the pieces stay the same, they are made again."""

    def __init__(self, most: int):
        self.most = most
        self._begin()

    def _begin(self) -> None:
        self.states, self.entries = np.zeros(0, U64), np.zeros(0, np.int64)   # sorted by state
        self.flat, self.names = Growing(np.int32), Growing(U64)
        self.begin = self.size = self.first = self.count = np.zeros(0, np.int64)
        self.skipped = np.zeros(0, U64)

    def room(self) -> None:
        if self.names.n > self.most:
            self._begin()

    def met(self):
        return self.names.all(), self.first, self.count

    def find(self, states):
        """(entry of each of the sorted ``states``, -1 where it has none; places of those)."""
        if not len(self.states):
            return np.full(len(states), -1), np.arange(len(states))
        at = np.minimum(np.searchsorted(self.states, states), len(self.states) - 1)
        entry = np.where(self.states[at] == states, self.entries[at], -1)
        return entry, np.flatnonzero(entry < 0)

    def add(self, states, entry, new, made, skipped):
        """``entry`` with the entries of the new states, which are made of ``_pieces_of``'s result."""
        (flat, begin, size), (names, first, count) = made
        entry = entry.copy()
        entry[new] = len(self.begin) + np.arange(len(new))
        at = np.searchsorted(self.states, states[new])
        self.states, self.entries = np.insert(self.states, at, states[new]), np.insert(self.entries, at, entry[new])
        self.begin, self.size = np.r_[self.begin, begin + self.flat.n], np.r_[self.size, size]
        self.first, self.count = np.r_[self.first, first + self.names.n], np.r_[self.count, count]
        self.skipped = np.r_[self.skipped, skipped]
        self.flat.append(flat)
        self.names.append(names)
        return entry


class Coder:
    """Encoder and decoder for one task."""

    def __init__(self, vocab: dict, rate: float = RATE, seed: int = SEED, book: int = BOOK):
        vars(self).update(vocab)
        self.book, self.pairs = Book(book), Merges(self.keys, self.merged)
        self.index = {n: i for i, n in enumerate(self.names)}
        self.limit, self.seed, self.powers = U64(int(rate * (1 << 32))), seed, Powers()
        self.units = re.compile(f" *[^ {LONE}]+| +|[{LONE}]")
        blob = [len(v) for v in self.values]
        self.value_size = np.array(blob, np.int64)
        self.value_at = np.cumsum(self.value_size) - self.value_size
        self.value_bytes = np.frombuffer(b"".join(self.values), np.uint8)
        self.space = byte_class(0x20)
        self.lone = byte_class(*LONE.encode())
        self.symbol_of = np.full(0x110000, -1, np.int32)     # character -> piece
        for n, i in self.index.items():
            if len(n) == 1:
                self.symbol_of[ord(" " if n == SPACE else n)] = i

    def documents(self, doc_ids) -> np.ndarray:
        """Keyed hash of each document's id."""
        h = np.array([number_of(i) for i in doc_ids], U64)
        return mix(mix(h + U64(self.seed)) ^ U64(self.seed))

    def keys_of(self, unit_hash, document, place):
        """Keys that decide all merges of a unit at a byte place of a document."""
        return mix(unit_hash ^ mix(document + np.asarray(place).astype(U64) * BASE))

    @staticmethod
    def candidate(at, piece):
        """Name of a candidate within its unit, not 0: place of the first character, piece."""
        return mix(((np.asarray(at).astype(U64) + U64(1)) << U64(32)) | np.asarray(piece).astype(U64))

    def dropped(self, key, candidate):
        """Keyed coin of candidates."""
        return (mix(key ^ candidate) >> U64(32)) < self.limit

    def unit(self, text: str, key, met: list | None = None) -> list[int]:
        """Piece ids of one unit, by an agenda kept as a heap; without coins if ``key``
        is None.  The candidates met are added to ``met``."""
        chars = [SPACE if c == " " else "" if c == SPACE else c for c in text]
        symbols = [self.index.get(c, -1) for c in chars]
        n, agenda, width = len(symbols), [], len(self.names)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))

        def offer(places) -> None:
            pairs = [i for i in places if i >= 0 and after[i] < n and symbols[i] >= 0 and symbols[after[i]] >= 0]
            if not pairs:
                return
            wanted = np.array([symbols[i] * width + symbols[after[i]] for i in pairs], np.int64)
            piece, ok = self.pairs.find(wanted)
            names = self.candidate(np.array(pairs), piece)
            if met is not None:
                met.append(names[ok])
            if key is not None:
                ok &= ~self.dropped(np.full(len(pairs), key, U64), names)
            for i, p, good in zip(pairs, piece.tolist(), ok.tolist()):
                if good:
                    heapq.heappush(agenda, (int(self.rank[p]), i, after[i], p, symbols[i], symbols[after[i]]))

        offer(range(n))
        while agenda:
            _, i, j, p, left, right = heapq.heappop(agenda)
            if symbols[i] != left or after[i] != j or j >= n or symbols[j] != right:
                continue                                     # one side has merged meanwhile
            symbols[i], symbols[j] = p, -2
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer([before[i], i])
        out, i = [], 0
        while i < n:
            if symbols[i] >= 0:
                out.append(int(self.ids[symbols[i]]))
            else:
                out.extend(self.bytes[b] for b in (chars[i] or SPACE).encode())
            i = after[i]
        return out

    def _pairs(self, key, left, right, at, rows, met):
        """(rank, piece) of candidate pairs; ``NEVER`` where nothing merges or the coin says
        skip.  (rows, candidates) are added to ``met``."""
        both = (left >= 0) & (right >= 0)
        piece, ok = self.pairs.find(np.where(both, left.astype(np.int64) * len(self.names) + right, 0))
        ok &= both
        rank = np.full(ok.shape, NEVER, np.int32)
        names = self.candidate(at[ok], piece[ok])
        rows = np.broadcast_to(rows, ok.shape)[ok]
        met.append((rows, names))
        rank[ok] = self.rank[piece[ok]]
        if key is not None:
            rank[ok] = np.where(self.dropped(key[rows], names), NEVER, rank[ok])
        return rank, piece

    def _agendas(self, symbols, key, met):
        """Final symbols (units x places, -1 after the end) of units without byte
        pieces; in every step each unit makes its best open merge."""
        n, width = symbols.shape
        done = symbols.copy()
        rows = np.arange(n)
        s, at = symbols, np.tile(np.arange(width, dtype=np.int32), (n, 1))
        rank, piece = self._pairs(key, s[:, :-1], s[:, 1:], at[:, :-1], rows[:, None], met)
        while len(rows):
            best = rank.argmin(axis=1)
            go = rank[np.arange(len(rows)), best] < NEVER
            done[rows[~go], : s.shape[1]] = s[~go]
            done[rows[~go], s.shape[1]:] = -1
            me = np.flatnonzero(go)
            rows, best = rows[me], best[me]
            if not len(rows):
                break
            wide = s.shape[1]
            s[me, best] = piece[me, best]
            place = np.arange(wide - 1)[None, :]
            take = (me * wide)[:, None] + place + (place > best[:, None])
            s, at = s.take(take), at.take(take)
            if wide == 2:
                done[rows, :1], done[rows, 1:] = s, -1
                break
            # Of the pairs, the merged one goes; its neighbours are looked up again.
            place = place[:, : wide - 2]
            take = (me * (wide - 1))[:, None] + place + (place >= best[:, None])
            rank, piece = rank.take(take), piece.take(take)
            for side in (best - 1, best):
                ok = np.flatnonzero((side >= 0) & (side < wide - 2))
                c = side[ok]
                rank[ok, c], piece[ok, c] = self._pairs(key, s[ok, c], s[ok, c + 1], at[ok, c], rows[ok], met)
        return done

    def _pieces_of(self, symbols, first, size, texts_of, key):
        """Pieces of units, given as character ranges of a symbol stream, and the
        candidates met: for each (flat values, start of each unit, size of each
        unit).  ``key`` is None for the segmentation without coins."""
        strange = np.r_[0, np.cumsum(symbols < 0)]
        slow = np.flatnonzero((size > LONG) | (strange[first + size] > strange[first]))
        quick = np.ones(len(first), bool)
        quick[slow] = False
        parts, met = [], []
        for i in slow.tolist():
            seen: list = []
            ids = self.unit(texts_of(i), None if key is None else key[i], seen)
            parts.append((np.full(len(ids), i), np.array(ids, np.int32)))
            names = np.concatenate(seen) if seen else np.zeros(0, U64)
            met.append((np.full(len(names), i), names))
        width_of = -(-size // 3) * 3
        for width in np.unique(width_of[quick]).tolist():
            members = np.flatnonzero(quick & (width_of == width))
            for lo in range(0, len(members), CHUNK):
                m = members[lo: lo + CHUNK]
                place = np.arange(width)[None, :]
                inside = place < size[m][:, None]
                matrix = np.where(inside, symbols[np.minimum(first[m][:, None] + place, len(symbols) - 1)], -1)
                seen = []
                out = self._agendas(matrix, None if key is None else key[m], seen)
                row, col = np.nonzero(out >= 0)
                parts.append((m[row], self.ids[out[row, col]]))
                met += [(m[r], names) for r, names in seen]
        return by_unit(parts, len(first), np.int32), by_unit(met, len(first), U64)

    def _coins(self, key, unit, met):
        """Sum of the names of the candidates that each occurrence skips, out of those
        met by its unit."""
        names, begin, count = met
        out = np.zeros(len(key), U64)
        for lo in range(0, len(key), CHUNK):
            u = unit[lo: lo + CHUNK]
            n = count[u]
            total = np.cumsum(n)
            name = names[np.repeat(begin[u] - (total - n), n) + np.arange(int(total[-1]))]
            skipped = np.where(self.dropped(np.repeat(key[lo: lo + CHUNK], n), name), name, U64(0))
            sums = np.r_[U64(0), np.cumsum(skipped)]
            out[lo: lo + CHUNK] = sums[total] - sums[total - n]
        return out

    def encode_slice(self, data, off, doc_ids):
        """(piece ids, offsets per document) of a slice of texts."""
        n_docs = len(off) - 1
        if len(data) == 0:
            return np.zeros(0, np.int32), np.zeros(n_docs + 1, np.int64)
        space, lone = self.space[data], self.lone[data]
        first = lone.copy()
        first[1:] |= lone[:-1] | (space[1:] & ~space[:-1])
        first[off[:-1][off[:-1] < len(data)]] = True
        start = np.flatnonzero(first)
        end = np.r_[start[1:], len(data)]
        doc = np.searchsorted(off, start, side="right") - 1
        unit_hash = self.powers.spans(self.powers.prefix(data), start, end)
        key = self.keys_of(unit_hash, self.documents(doc_ids)[doc], start - off[doc])
        text = data.tobytes().decode()
        symbols = self.symbol_of[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        chars = np.cumsum((data & 0xC0) != 0x80)             # characters up to each byte
        c_first = chars[start] - 1
        c_size = chars[end - 1] - c_first

        def pieces(of, keys):
            a, n = c_first[of], c_size[of]
            return self._pieces_of(symbols, a, n, lambda i: text[a[i]: a[i] + n[i]], keys)

        # Rounds: an occurrence's state names an entry of the book; where its coins skip other
        # candidates than the entry did, its state goes on to an entry that knows these.
        self.book.room()
        state, open_ = unit_hash, np.arange(len(start))
        begin, size = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        plain = True
        while len(open_):
            names, sample, group = np.unique(state, return_index=True, return_inverse=True)
            entry, new = self.book.find(names)
            if len(new):
                of = open_[sample[new]]
                made = pieces(of, None if plain else key[of])
                skipped = np.zeros(len(new), U64) if plain else self._coins(key[of], np.arange(len(new)), made[1])
                entry = self.book.add(names, entry, new, made, skipped)
            entry = entry[group]
            begin[open_], size[open_] = self.book.begin[entry], self.book.size[entry]
            if not self.limit:
                break
            own = self._coins(key[open_], entry, self.book.met())
            other = own != self.book.skipped[entry]
            open_, own, state, plain = open_[other], own[other], state[other], False
            state = mix(own ^ mix(state * BASE))
        flat = self.book.flat.all()
        total = np.cumsum(size)
        ids = flat[np.repeat(begin - (total - size), size) + np.arange(int(total[-1]))]
        return ids, np.r_[0, np.cumsum(np.bincount(doc, weights=size, minlength=n_docs).astype(np.int64))]

    def same_text(self, ids, bounds, data, off):
        """Whether the decoded pieces of each document are its bytes."""
        size = self.value_size[ids]
        total = np.r_[0, np.cumsum(size)]
        out = self.value_bytes[np.repeat(self.value_at[ids] - total[:-1], size) + np.arange(int(total[-1]))]
        ends = total[bounds]
        if (ends == off).all():
            wrong = np.r_[0, np.cumsum(out != data)]
            return wrong[off[1:]] == wrong[off[:-1]]
        return np.array([bytes(out[a:b]) == bytes(data[c:d]) for a, b, c, d in zip(ends, ends[1:], off, off[1:])], bool)

    def encode(self, text: str, doc_id) -> list[int]:
        """Piece ids of one text."""
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_slice(data, np.array([0, len(data)]), [doc_id])[0].tolist()

    def encode_by_heap(self, text: str, doc_id) -> list[int]:
        """The same by the heap alone, unit for unit."""
        out: list[int] = []
        document, place = self.documents([doc_id]), 0
        for u in self.units.findall(text):
            data = np.frombuffer(u.encode(), np.uint8)
            whole = self.powers.spans(self.powers.prefix(data), np.array([0]), np.array([len(data)]))
            out += self.unit(u, self.keys_of(whole, document, place)[0])
            place += len(data)
        return out

    def decode(self, ids) -> str:
        values = self.values
        return b"".join([values[i] for i in ids]).decode("utf-8", "replace")


def with_pieces(docs: DataFrame, model: str = MODEL, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """``docs`` with ``pieces`` (ids), ``n_pieces`` and ``lossless`` (decoding gave the
    text back); columns of these names are replaced."""
    docs = docs.drop("pieces", "n_pieces", "lossless")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model))

    def run(batches):
        import pyarrow as pa

        coder = Coder(shared.value, rate, seed)
        for batch in batches:
            for rows, data, off, null in slices(batch, most=SLICE):
                ids, bounds = coder.encode_slice(data, off, rows.column("doc_id").to_pylist())
                ok = coder.same_text(ids, bounds, data, off)
                size = np.diff(bounds)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, lists, pa.array(size, mask=null), pa.array(ok, mask=null)],
                    [*rows.schema.names, "pieces", "n_pieces", "lossless"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(lean(run), ", ".join([*kinds, "pieces array<int>", "n_pieces long", "lossless boolean"]))


def encode(docs: DataFrame, model: str = MODEL, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """(doc_id, pieces, n_pieces, lossless)."""
    return with_pieces(docs.select("doc_id", "text"), model, rate, seed).drop("text")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, pieces)."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(model))

    def run(batches):
        import pyarrow as pa

        coder = Coder(shared.value)
        for batch in batches:
            texts = [None if p is None else coder.decode(p) for p in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(lean(run), f"doc_id {kind}, text string")
