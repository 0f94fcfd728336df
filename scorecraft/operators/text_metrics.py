"""Text scoring (O-51, O-52, O-69..O-75).

Pairs arrive as ``(record_id, reference_text, prediction_text)``.
- Levenshtein distance: Spark's built-in ``levenshtein`` (code points).
- Levenshtein ratio and ROUGE-L need LCS lengths: one Arrow UDF pass
  computes the character and the token LCS of each pair (exact, whole text).
- ROUGE-1 is relational: tokens are exploded and counted per (record, token) and
  side before the shuffle, then ``least`` is summed.
- The greedy embedding match (matching core of BERTScore) multiplies blocks of at
  most ``block`` token positions a side, each pair of blocks by a task of its own, so a
  very long record is spread instead of gathered.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorecraft.functions.lcs import lcs_lengths
from scorecraft.functions.partitioning import by_key

FAMILIES = {
    "rouge": ["rouge1", "rougeL"],
    "levenshtein": ["levenshtein_distance", "levenshtein_ratio"],
    "bert": ["bert_precision", "bert_recall", "bert_f1"],
    "judge": [],  # one column per enabled judge metric, see exchange.judge_scores_pivot
}


def rouge_tokens(c: Column) -> Column:
    """Lower-case, non-alphanumerics to blanks, split; no stemming."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda t: t != "")


def scorable(items: DataFrame) -> DataFrame:
    """O-51: text metrics apply only where truth and prediction are both text
    and both non-empty."""
    return items.filter((F.col("gt_type") == "nlp") & (F.col("pred_type") == "nlp")
                        & (F.length("reference_text") > 0) & (F.length("prediction_text") > 0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def levenshtein_distance(pairs: DataFrame) -> DataFrame:
    """O-69 with the built-in (JVM) ``levenshtein``; pairs are spread over
    the shuffle partitions first, as each pair is O(n*m) work."""
    return by_key(pairs, "record_id").select("record_id", F.levenshtein("prediction_text", "reference_text")
                        .cast("double").alias("score_levenshtein_distance"))


def lcs_scores(pairs: DataFrame) -> DataFrame:
    """Levenshtein ratio (2*LCS / total length; substitution costs 2) and
    ROUGE-L F1 (token LCS), from one UDF pass."""
    rt, pt = rouge_tokens(F.col("reference_text")), rouge_tokens(F.col("prediction_text"))
    d = by_key(pairs, "record_id").select("record_id", "reference_text", "prediction_text", rt.alias("rt"), pt.alias("pt"))
    d = d.withColumn("_l", lcs_lengths("reference_text", "prediction_text", "rt", "pt"))
    total = F.length("reference_text") + F.length("prediction_text")
    ratio = F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.col("_l.char_lcs") / total)
    n_r, n_p = F.size("rt"), F.size("pt")
    tok = F.col("_l.token_lcs").cast("double")
    p = F.when((n_p > 0) & (n_r > 0), tok / n_p).otherwise(F.lit(0.0))
    r = F.when((n_p > 0) & (n_r > 0), tok / n_r).otherwise(F.lit(0.0))
    return d.select("record_id", ratio.alias("score_levenshtein_ratio"), _f1(p, r).alias("score_rougeL"),
                    F.col("_l.edit_distance").cast("double").alias("score_levenshtein_distance"))


def rouge1(pairs: DataFrame) -> DataFrame:
    """ROUGE-1 F1: clipped unigram overlap (multiset, not set).  A text's equal tokens are
    counted where the text is read, so one row per different token is shuffled."""
    sides = F.array(F.struct(F.lit(True).alias("ref"), rouge_tokens(F.col("reference_text")).alias("toks")),
                    F.struct(F.lit(False).alias("ref"), rouge_tokens(F.col("prediction_text")).alias("toks")))
    counts = (pairs.select("record_id", F.inline(sides)).select("record_id", "ref", F.explode("toks").alias("token"))
              .groupBy("record_id", "token").agg(F.count_if("ref").alias("rc"), F.count_if(~F.col("ref")).alias("pc")))
    per = counts.groupBy("record_id").agg(F.sum(F.least("rc", "pc")).alias("overlap"), F.sum("rc").alias("n_ref"),
                                          F.sum("pc").alias("n_pred"))
    out = pairs.select("record_id").join(per, "record_id", "left")
    ov = F.coalesce("overlap", F.lit(0)).cast("double")
    p = ov / F.greatest(F.coalesce("n_pred", F.lit(0)), F.lit(1))
    r = ov / F.greatest(F.coalesce("n_ref", F.lit(0)), F.lit(1))
    return out.select("record_id", _f1(p, r).alias("score_rouge1"))


def _unit(vec: Column) -> Column:
    v = F.transform(vec, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))   # a zero vector matches nothing


def _matrix(vectors) -> np.ndarray:
    """An Arrow list column as the rows of a matrix, short ones filled up with zeros."""
    ends = vectors.offsets.to_numpy()
    width = np.diff(ends)
    out = np.zeros((len(width), width.max(initial=0)))
    out[np.arange(out.shape[1]) < width[:, None]] = vectors.values.to_numpy(zero_copy_only=False)[ends[0]: ends[-1]]
    return out


def _best_in_pairs(table):
    """Per token of whole block pairs (rows of a pair adjacent, predictions first) its best
    cosine to the other side of the pair."""
    import pyarrow as pa

    ids = np.array(table.column("record_id").to_pylist(), dtype=object)
    blocks = np.stack([table.column(c).to_numpy() for c in ("pred_block", "ref_block")])
    ref = table.column("side").to_numpy(zero_copy_only=False) == "ref"
    vectors = _matrix(table.column("u").combine_chunks())
    new = np.flatnonzero((ids[1:] != ids[:-1]) | (blocks[:, 1:] != blocks[:, :-1]).any(axis=0)) + 1
    best = np.empty(len(ids))
    for lo, hi in zip([0, *new], [*new, len(ids)]):
        mid = lo + int((~ref[lo:hi]).sum())
        cosines = vectors[lo:mid] @ vectors[mid:hi].T
        best[lo:mid], best[mid:hi] = cosines.max(axis=1), cosines.max(axis=0)
    return table.select(["record_id", "side", "pos"]).append_column("m", pa.array(best))


def _best_cosines(batches):
    """Matrix products of the block pairs of a sorted stream; the rows of a pair that goes on
    in the next batch, at most two blocks, wait for it."""
    import pyarrow as pa

    waiting = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if waiting is None else pa.concat_tables([waiting, table])
        ids = np.array(table.column("record_id").to_pylist(), dtype=object)
        blocks = np.stack([table.column(c).to_numpy() for c in ("pred_block", "ref_block")])
        last = np.flatnonzero((ids != ids[-1]) | (blocks != blocks[:, -1:]).any(axis=0)) if len(ids) else []
        whole = int(last[-1]) + 1 if len(last) else 0
        waiting = table.slice(whole)
        if whole:
            yield from _best_in_pairs(table.slice(0, whole)).to_batches()
    if waiting is not None and len(waiting):
        yield from _best_in_pairs(waiting).to_batches()


def greedy_embedding_match(token_vecs: DataFrame, block: int = 256) -> DataFrame:
    """O-73: precision = mean over predicted tokens of the max cosine to any
    reference token; recall symmetric; F1 harmonic.  Input
    ``(record_id, side 'ref'|'pred', pos, vec)``; tokens without a vector do not count.

    Both sides are cut into blocks of ``block`` positions.  Every pair of a record's blocks is
    a key of its own, so a long record spreads over tasks, and one matrix product per pair
    serves both directions; the maxima over pairs are merged by aggregation."""
    v = token_vecs.filter("vec IS NOT NULL").select("record_id", "side", "pos", _unit(F.col("vec")).alias("u"),
                                                     F.coalesce(F.floor(F.col("pos") / block), F.lit(-1)).alias("block"))
    sides = v.filter("side IN ('ref', 'pred')")
    held = sides.groupBy("record_id").agg(*[F.collect_set(F.when(F.col("side") == s, F.col("block"))).alias(s) for s in ("pred", "ref")])
    is_ref = F.col("side") == "ref"
    met = (sides.join(held, "record_id").withColumn("other", F.explode(F.when(is_ref, F.col("pred")).otherwise(F.col("ref"))))
           .select("record_id", "side", "pos", "u", F.when(is_ref, F.col("other")).otherwise(F.col("block")).alias("pred_block"),
                   F.when(is_ref, F.col("block")).otherwise(F.col("other")).alias("ref_block")))
    pair = ["record_id", "pred_block", "ref_block"]
    kinds = {f.name: f.dataType.simpleString() for f in met.schema}
    best = (by_key(met, *pair).sortWithinPartitions(*pair, "side")
            .mapInArrow(_best_cosines, f"record_id {kinds['record_id']}, side string, pos {kinds['pos']}, m double")
            .groupBy("record_id", "side", "pos").agg(F.max("m").alias("m")))
    means = best.groupBy("record_id").agg(F.avg(F.when(F.col("side") == "pred", F.col("m"))).alias("score_bert_precision"),
                                          F.avg(F.when(F.col("side") == "ref", F.col("m"))).alias("score_bert_recall"))
    # A record with tokens on one side only has nothing to match: 0.
    out = token_vecs.select("record_id").distinct().join(means, "record_id", "left").na.fill(
        0.0, ["score_bert_precision", "score_bert_recall"])
    return out.withColumn("score_bert_f1", _f1(F.col("score_bert_precision"), F.col("score_bert_recall")))


def content_scores(items: DataFrame, families: list[str], token_vecs: DataFrame | None = None,
                   judge: DataFrame | None = None) -> DataFrame:
    """O-74/O-75/O-52: score the scorable rows with the requested metric
    families and return every input row with its scores (NULL where a
    metric does not apply).  Unknown family names raise."""
    unknown = [f for f in families if f not in FAMILIES]
    if unknown:
        raise ValueError(f"unknown metric families: {unknown}")
    pairs = scorable(items).select("record_id", "reference_text", "prediction_text")
    cols: list[str] = []
    out = items
    if "rouge" in families or "levenshtein" in families:
        # One UDF pass gives ratio, ROUGE-L and the edit distance.
        lcs = lcs_scores(pairs)
        keep = (["score_levenshtein_distance", "score_levenshtein_ratio"] if "levenshtein" in families else []) + \
               (["score_rougeL"] if "rouge" in families else [])
        out = out.join(lcs.select("record_id", *keep), "record_id", "left")
        cols += keep
    if "rouge" in families:
        out = out.join(rouge1(pairs), "record_id", "left")
        cols.append("score_rouge1")
    if "bert" in families:
        if token_vecs is None:
            raise ValueError("the bert family needs token vectors")
        bert = greedy_embedding_match(token_vecs.join(pairs.select("record_id"), "record_id", "left_semi"))
        out = out.join(bert, "record_id", "left")
        cols += ["score_bert_precision", "score_bert_recall", "score_bert_f1"]
    if "judge" in families:
        if judge is None:
            raise ValueError("the judge family needs a table of judge scores")
        jcols = [c for c in judge.columns if c != "record_id"]
        out = out.join(judge.join(pairs.select("record_id"), "record_id", "left_semi"), "record_id", "left")
        cols += jcols
    return out
