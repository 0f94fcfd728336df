"""Language identification by cross-parsing entropy.

Per language a suffix automaton of labelled text accepts every substring of
that text.  A document is cut into blocks, and each block is parsed against
each language by longest matches: the automaton is followed as long as it has
a transition, and where it has none a phrase ends and the next one begins.  A
language's cost is phrases x log2(reference length) / symbols; the lowest cost
wins.  The automata are stored as dense transition rows, so all blocks of a
slice of documents advance together, one symbol of every block per step.

The reference text is a bounded sample: at most ``sample_docs`` labelled
documents per language and ``sample_symbols`` symbols of them.  Prediction
covers whole texts; a phrase never runs across a block border, the same for
every language.

Texts that are null, empty or without a letter give ``und`` and score 0; ties
go to the language that sorts first; with no labelled rows all are ``und``.
Rows without an id are predicted, not learned from; of rows that share an id the one with
the smallest hash of the text is learned from.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorecraft.llm.batches import slices

BLOCK = 2_048
SLICE = 1 << 20
DENSE = 62                     # letters with a column of their own in the transition rows
GAP, STRANGE = 0, 1            # symbols: no letter; a letter never seen in the references


def held_out(doc_id) -> F.Column:
    """True for the documents that no model may learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def suffix_automaton(symbols) -> list[dict]:
    """Transitions of the suffix automaton of a symbol sequence; state 0 is the root."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return nxt


def to_symbols(text: str, table):
    """Symbols of a text: letters by ``table``, each run of others as one gap."""
    s = table[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    if len(s) > 1:
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != GAP) | (s[:-1] != GAP)
        s = s[keep]
    return s


class LanguageModel:
    """Stacked transition rows of all languages.

    Every letter of the references has a symbol.  The ``DENSE`` most frequent letters are
    columns of the rows; the transitions by all others are kept sparsely, as
    sorted numbers of (row, symbol).

    A stored value >= 0 is the next row.  Where the automaton has no transition
    the value is the bitwise complement of the row after the next phrase's first
    symbol, so a negative value marks the end of a phrase.  A symbol that the
    language lacks is a phrase of its own; the row after it ends at once.
    """

    def __init__(self, references: dict[str, str]):
        self.langs = sorted(references)
        count = Counter(c for t in references.values() for c in t.lower() if c.isalpha())
        letters = sorted(count, key=lambda c: (-count[c], c))
        table = np.zeros(0x110000, np.int32)
        table[[i for i in range(0x110000) if chr(i).isalpha()]] = STRANGE
        for i, c in enumerate(letters):
            table[ord(c)] = i + 2
        self.table, self.symbols = table, len(letters) + 2
        self.width = min(self.symbols, DENSE + 2)
        self.fresh = np.zeros((len(self.langs), self.symbols - self.width), np.int32)     # row after a rare first symbol
        keys, values = [], []
        rows, self.roots, self.cost, base = [], [], [], 0
        for lang in self.langs:
            symbols = to_symbols(references[lang], table)
            nxt = suffix_automaton(symbols[symbols != STRANGE].tolist())
            alone = base + len(nxt)                          # after a symbol the language lacks
            root = np.full(self.symbols, alone, np.int32)
            for c, q in nxt[0].items():
                root[c] = base + q
            self.fresh[len(self.roots)] = root[self.width:]
            part = np.tile(~root[: self.width], (len(nxt) + 1, 1))
            part[0] = root[: self.width]
            at = [(p, c, q) for p, d in enumerate(nxt) for c, q in d.items()]
            if at:
                p, c, q = np.array(at, np.int64).T
                often = c < self.width
                part[p[often], c[often]] = base + q[often]
                keys.append((base + p[~often]) * self.symbols + c[~often])
                values.append(base + q[~often])
            rows.append(part)
            self.roots.append(base)
            self.cost.append(float(np.log2(max(2, len(symbols)))))
            base += len(nxt) + 1
        self.flat = np.concatenate(rows).ravel() if rows else np.zeros(0, np.int32)
        rare = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(rare)
        self.rare = np.r_[rare[order], np.iinfo(np.int64).max]
        self.after = np.r_[np.concatenate(values)[order] if keys else np.zeros(0, np.int64), 0].astype(np.int32)

    def rare_steps(self, state, c):
        """Values of the transitions of every language by symbols without a column."""
        key = state.astype(np.int64) * self.symbols + c
        at = np.searchsorted(self.rare, key)
        first = self.fresh[:, c - self.width]
        at_root = state == np.array(self.roots, np.int32)[:, None]
        return np.where(self.rare[at] == key, self.after[at], np.where(at_root, first, ~first))

    def costs(self, texts: list[str]):
        """(cost per text and language, whether a text has a letter)."""
        parts = [to_symbols(t, self.table) for t in texts]
        sizes = np.array([len(p) for p in parts], np.int64)
        letter = np.array([bool((p != GAP).any()) for p in parts], bool)
        stream = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * BLOCK
        size = np.minimum(sizes[owner] - nth * BLOCK, BLOCK)
        order = np.argsort(-size, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        n = len(owner)
        state = np.repeat(np.array(self.roots, np.int32)[:, None], n, axis=1)
        phrases = np.ones((len(self.langs), n), np.int32)
        active = n
        for t in range(int(size[0]) if n else 0):
            while size[active - 1] <= t:
                active -= 1
            c = stream[start[:active] + t]
            rare = np.flatnonzero(c >= self.width) if self.width < self.symbols else c[:0]
            if len(rare):
                nxt = self.flat[state[:, :active] * np.int32(self.width) + np.minimum(c, self.width - 1)]
                nxt[:, rare] = self.rare_steps(state[:, rare], c[rare])
            else:
                nxt = self.flat[state[:, :active] * np.int32(self.width) + c]
            ended = nxt >> 31
            phrases[:, :active] -= ended
            state[:, :active] = nxt ^ ended
        total = np.array([np.bincount(owner, weights=row, minlength=len(texts)) for row in phrases])
        total = total.reshape(len(self.langs), len(texts))
        return total * np.array(self.cost)[:, None] / np.maximum(sizes, 1), letter


def fit(labelled: DataFrame, sample_docs: int = 60, sample_symbols: int = 40_000,
        longest: int = 20_000) -> LanguageModel:
    """Model from rows (doc_id, text, lang).  Per language the documents that
    come first by hash are taken, those of at most ``longest`` characters
    before longer ones, until ``sample_symbols`` characters are gathered."""
    rows = labelled.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    key = F.struct((F.length("text") > longest).alias("long"), F.xxhash64("doc_id").alias("h"), F.col("doc_id"))
    picked = (rows.select("lang", "doc_id", key.alias("k"))
              .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("k")))
              .filter(F.col("n") <= sample_docs).groupBy("lang", "doc_id").agg(F.min("n").alias("n")))
    sample = (rows.select("doc_id", "lang", F.substring("text", 1, sample_symbols).alias("text"))
              .join(F.broadcast(picked), ["doc_id", "lang"]).groupBy("lang", "n")
              .agg(F.min_by("text", F.xxhash64("text")).alias("text")).orderBy("lang", "n").toLocalIterator())
    references: dict[str, str] = {}
    for r in sample:
        have = references.get(r.lang, "")
        if len(have) < sample_symbols:
            references[r.lang] = have + "\n" + r.text[: sample_symbols - len(have)]
    return LanguageModel(references)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score): score is 1 - best cost / second cost."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))      # plain arrays and lists
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        m = LanguageModel.__new__(LanguageModel)
        vars(m).update(shared.value)
        for batch in batches:
            for rows, _, _, _ in slices(batch, most=SLICE):
                texts = [t or "" for t in rows.column("text").to_pylist()]
                cost, letter = m.costs(texts)
                if len(m.langs) == 0:
                    best, score, letter = np.zeros(len(texts), int), np.zeros(len(texts)), letter & False
                else:
                    best = cost.argmin(axis=0)
                    low = np.sort(cost, axis=0)
                    score = 1 - low[0] / np.maximum(low[1], 1e-12) if len(m.langs) > 1 else np.ones(len(texts))
                names = [m.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letter.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(names, pa.string()),
                     pa.array(np.where(letter, np.clip(score, 0, 1), 0.0), pa.float64())],
                    ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
