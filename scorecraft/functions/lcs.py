"""Longest-common-subsequence lengths as one Arrow-batched UDF.

LCS has no built-in Spark expression.  Spark's ``levenshtein`` is the O(n*m)
dynamic program; the bit-vector edit distance here is computed in the same
pass as the LCS lengths.  The bit-parallel recurrence
(Allison & Dix 1986; Crochemore et al. 2001) processes one symbol of the
shorter sequence per step over a bit vector of the longer one, so a pair of
n- and m-symbol sequences costs O(n) big-integer operations of m bits.  It is
exact and handles whole texts (no truncation).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence of two sequences."""
    if len(a) < len(b):
        a, b = b, a
    n = len(a)
    if n == 0 or len(b) == 0:
        return 0
    masks: dict = {}
    for i, sym in enumerate(a):
        masks[sym] = masks.get(sym, 0) | (1 << i)
    full = (1 << n) - 1
    s = full
    for sym in b:
        m = masks.get(sym)
        if m:
            u = s & m
            s = ((s + u) | (s - u)) & full
    return n - bin(s).count("1")


def edit_distance(a, b) -> int:
    """Levenshtein distance (unit insert/delete/substitute) with the
    bit-vector algorithm of Myers (1999) in Hyyro's formulation: one pass
    over ``a`` with bit vectors as long as ``b``."""
    if len(a) < len(b):
        a, b = b, a
    m = len(b)
    if m == 0:
        return len(a)
    peq: dict = {}
    for i, sym in enumerate(b):
        peq[sym] = peq.get(sym, 0) | (1 << i)
    full = (1 << m) - 1
    top = 1 << (m - 1)
    pv, mv, score = full, 0, m
    for sym in a:
        eq = peq.get(sym, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ((ph << 1) | 1) & full
        mh = (mh << 1) & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
    return score


LCS_SCHEMA = T.StructType([
    T.StructField("char_lcs", T.LongType()),
    T.StructField("token_lcs", T.LongType()),
    T.StructField("edit_distance", T.LongType()),
])


@F.pandas_udf(LCS_SCHEMA)
def lcs_lengths(ref: pd.Series, pred: pd.Series, ref_tok: pd.Series, pred_tok: pd.Series) -> pd.DataFrame:
    """Character LCS and edit distance of the texts, token LCS of the token
    arrays."""
    chars = [None if (r is None or p is None) else lcs_length(r, p) for r, p in zip(ref, pred)]
    edits = [None if (r is None or p is None) else edit_distance(r, p) for r, p in zip(ref, pred)]
    toks = [None if (r is None or p is None) else lcs_length(list(r), list(p)) for r, p in zip(ref_tok, pred_tok)]
    return pd.DataFrame({"char_lcs": pd.array(chars, dtype="Int64"), "token_lcs": pd.array(toks, dtype="Int64"),
                         "edit_distance": pd.array(edits, dtype="Int64")})
