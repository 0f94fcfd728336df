"""Token counts that follow edits without encoding the whole text again.

The state of a document is its text and a segment tree.  The leaves are runs of
pre-tokens of about ``LEAF`` characters, cut only where the pre-token pattern
has a border whatever stands further off: between a non-space and a single
space that a non-space follows.  Every node holds the characters and tokens
below it, so a place is found by descent and a total is the root.

An edit replaces characters [start, end).  The leaves it touches are taken, and
a neighbour too where the edit comes so near to a cut that the cut may move
(the characters on both sides of it and the space are its context).  Only that
region is cut and encoded again, into as many leaves as before, and the sums
above them are set anew.

Null texts have null counts; empty texts one empty leaf.  Edits of a document
refer to its text before any of them, must not overlap, and are clipped to it;
null lists and null replacements are empty.  Repeated rows are counted one by
one.  Columns besides those named are passed through.
"""

from __future__ import annotations

import base64
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 512
CUT = re.compile(r"(?<=\S) (?=\S)")
EDIT = "array<struct<start: bigint, end: bigint, replacement: string>>"


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encoder(ranks: dict[bytes, int], pattern: str = PATTERN):
    import tiktoken

    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def cut_text(text: str, leaf: int = LEAF) -> list[str]:
    """The text in pieces of at least ``leaf`` characters, cut at safe places."""
    out, at = [], 0
    while True:
        m = CUT.search(text, at + leaf)
        if m is None:
            out.append(text[at:])
            return out
        out.append(text[at: m.start()])
        at = m.start()


def fit_pieces(text: str, n: int) -> list[str]:
    """The text in exactly ``n`` pieces cut at safe places; spare ones are empty."""
    pieces = cut_text(text, max(1, len(text) // n)) if text else []
    while len(pieces) > n:
        pieces[-2:] = [pieces[-2] + pieces[-1]]
    return pieces + [""] * (n - len(pieces))


class SegmentTree:
    """Sums of characters and tokens over leaves; node i has children 2i and 2i+1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens, self.half = chars, tokens, len(chars) // 2

    @classmethod
    def build(cls, leaves: list[tuple[int, int]]) -> "SegmentTree":
        half = 1
        while half < len(leaves):
            half *= 2
        pad = [0] * (half - len(leaves))
        tree = cls([0] * half + [c for c, _ in leaves] + pad, [0] * half + [t for _, t in leaves] + pad)
        for i in range(half - 1, 0, -1):
            tree._sum(i)
        return tree

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds a place."""
        i, at = 1, 0
        while i < self.half:
            i *= 2
            if place >= at + self.chars[i] and self.chars[i + 1]:
                at += self.chars[i]
                i += 1
        return i - self.half, at

    def set(self, first: int, leaves: list[tuple[int, int]]) -> None:
        """New figures for consecutive leaves, and the sums above them."""
        for k, (c, t) in enumerate(leaves):
            self.chars[self.half + first + k], self.tokens[self.half + first + k] = c, t
        lo, hi = (self.half + first) // 2, (self.half + first + len(leaves) - 1) // 2
        while lo:
            for i in range(lo, hi + 1):
                self._sum(i)
            lo, hi = lo // 2, hi // 2

    def region(self, start: int, end: int) -> tuple[int, int, int, int]:
        """Leaves to encode again for an edit: (first leaf, last leaf, first
        character, end character)."""
        size = self.chars[1]
        first, lo = self.find(max(0, start - 2))             # its left cut is two characters away
        last, at = self.find(min(max(0, size - 1), end))     # its right cut is past the character after the edit
        hi = at + self.chars[self.half + last]
        if hi < end + 1 and hi < size:
            last, at = self.find(hi)
            hi = at + self.chars[self.half + last]
        return first, last, lo, hi


def apply_edits(text: str, tree: SegmentTree, edits: list[tuple[int, int, str]], count) -> tuple[str, int]:
    """Apply edits to the text and tree: (new text, characters encoded again)."""
    size = len(text)
    edits = sorted((min(max(s, 0), size), min(max(e, 0), size), r or "") for s, e, r in edits)
    groups: list[list] = []
    for s, e, r in edits:
        e = max(s, e)
        first, last, lo, hi = tree.region(s, e)
        if groups and first <= groups[-1][1]:                # the same leaves: one region
            g = groups[-1]
            g[1], g[3] = max(g[1], last), max(g[3], hi)
            g[4].append((s, e, r))
        else:
            groups.append([first, last, lo, hi, [(s, e, r)]])
    done = 0
    for first, last, lo, hi, own in reversed(groups):        # from the right: places on the left stay
        parts, at = [], lo
        for s, e, r in own:
            parts += [text[at: s], r]
            at = max(at, e)
        new = "".join(parts) + text[at: hi]
        text = text[:lo] + new + text[hi:]
        tree.set(first, [(len(p), count(p)) for p in fit_pieces(new, last - first + 1)])
        done += len(new)
    return text, done


def build(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``docs`` with the state of every document: ``tree_chars`` and ``tree_tokens`` (node
    sums, root at index 1) and ``n_tokens``."""
    docs = docs.drop("tree_chars", "tree_tokens", "n_tokens")
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks))

    def run(batches):
        import pyarrow as pa

        encode = encoder(shared.value).encode_ordinary
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                chars, tokens = [], []
                for t in rows.column("text").to_pylist():
                    tree = None if t is None else SegmentTree.build([(len(p), len(encode(p))) for p in cut_text(t)])
                    chars.append(tree and tree.chars)
                    tokens.append(tree and tree.tokens)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(chars, pa.list_(pa.int64())), pa.array(tokens, pa.list_(pa.int64())),
                     pa.array([t and t[1] for t in tokens], pa.int64())],
                    [*rows.schema.names, "tree_chars", "tree_tokens", "n_tokens"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(run, ", ".join([*kinds, "tree_chars array<long>, tree_tokens array<long>, n_tokens long"]))


def update(state: DataFrame, edits: str = "edits", ranks: str = RANKS) -> DataFrame:
    """State rows after the edits in array column ``edits`` (start, end, replacement):
    text, trees and ``n_tokens`` are new; ``n_encoded_chars`` says how much was encoded."""
    state = state.drop("n_encoded_chars").withColumn(edits, F.col(edits).cast(EDIT))
    shared = state.sparkSession.sparkContext.broadcast(load_ranks(ranks))

    def run(batches):
        import pyarrow as pa

        encode = encoder(shared.value).encode_ordinary
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                new: dict[str, list] = {"text": [], "tree_chars": [], "tree_tokens": [], "n_tokens": [], "n_encoded_chars": []}
                for t, c, k, e in zip(*(rows.column(x).to_pylist() for x in ("text", "tree_chars", "tree_tokens", edits))):
                    done = None
                    if t is not None:
                        tree = SegmentTree(c, k)
                        wanted = [(x["start"], x["end"], x["replacement"]) for x in e or []]
                        t, done = apply_edits(t, tree, wanted, lambda p: len(encode(p)))
                        c, k = tree.chars, tree.tokens
                    for name, v in zip(new, (t, c, k, None if k is None else k[1], done)):
                        new[name].append(v)
                kinds = {"text": pa.string(), "tree_chars": pa.list_(pa.int64()), "tree_tokens": pa.list_(pa.int64())}
                made = {c: pa.array(v, kinds.get(c, pa.int64())) for c, v in new.items()}
                names = [*rows.schema.names, "n_encoded_chars"]
                yield pa.RecordBatch.from_arrays([made[c] if c in made else rows.column(c) for c in names], names)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema]
    return state.mapInArrow(run, ", ".join([*kinds, "n_encoded_chars long"]))


def sample_edits(doc_id, text) -> F.Column:
    """Three edits per text (a replacement, a deletion, an insertion), one in each
    third, at places drawn from the id's hash; texts under 60 characters get the
    insertion alone."""
    size = F.coalesce(F.length(text), F.lit(0)).cast("long")
    third = F.floor(size / 3)

    def at(k: int):
        return third * k + F.pmod(F.xxhash64(doc_id, F.lit(k)), F.greatest(third - 15, F.lit(1)).cast("long"))

    def edit(start, width: int, new: str):
        return F.struct(start.cast("long").alias("start"), (start + width).cast("long").alias("end"),
                        F.lit(new).alias("replacement"))

    insertion = edit(at(2), 0, " (revised) ")
    return F.when(size >= 60, F.array(edit(at(0), 12, "corrected"), edit(at(1), 7, ""), insertion)).otherwise(F.array(insertion))
