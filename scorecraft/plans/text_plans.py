"""Plans over text pairs (fixture F-D) and token vectors (F-F): O-49,
O-51, O-52, O-69..O-75.

The predictions of F-D are whole reference texts with characters replaced or
added by a 7, which no reference holds.  A 7 matches nothing, so the common
subsequences are what is left and SQL can state distances exactly: every 7
and every added blank costs one edit.  tests/test_text_metrics.py checks
arbitrary pairs against brute force.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scorecraft.operators import text_metrics as X
from scorecraft.plans.fixtures import fixture, fixture_sql
from scorecraft.plans.registry import register, round_doubles, rounded_sql


def items(spark, sf_dir):
    fd = fixture(spark, sf_dir, "text_pairs")
    return fd.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("record_id"),
        F.lit("nlp").alias("gt_type"),
        F.when(F.col("prediction_text") == "", "error").otherwise("nlp").alias("pred_type"),
        "reference_text", "prediction_text")


def pairs(spark, sf_dir):
    return X.scorable(items(spark, sf_dir)).select("record_id", "reference_text", "prediction_text")


_BASE = "WITH fd AS (" + fixture_sql("text_pairs") + """)
, items AS (SELECT concat_ws(':', cast(conv_id AS VARCHAR), cast(turn AS VARCHAR)) AS record_id, 'nlp' AS gt_type,
                   CASE WHEN prediction_text = '' THEN 'error' ELSE 'nlp' END AS pred_type, reference_text, prediction_text FROM fd)
, pairs AS (SELECT * FROM items WHERE gt_type = 'nlp' AND pred_type = 'nlp' AND length(reference_text) > 0 AND length(prediction_text) > 0)
, tok AS (SELECT record_id, 'ref' AS side, unnest(list_filter(string_split(regexp_replace(lower(reference_text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')) AS token FROM pairs
          UNION ALL
          SELECT record_id, 'pred', unnest(list_filter(string_split(regexp_replace(lower(prediction_text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')) FROM pairs)
, cnt AS (SELECT record_id, side, token, count(*) AS c FROM tok GROUP BY 1, 2, 3)
, j AS (SELECT coalesce(r.record_id, p.record_id) AS record_id, coalesce(r.c, 0) AS rc, coalesce(p.c, 0) AS pc
        FROM (SELECT * FROM cnt WHERE side = 'ref') r FULL OUTER JOIN (SELECT * FROM cnt WHERE side = 'pred') p
        ON r.record_id = p.record_id AND r.token = p.token)
, per AS (SELECT record_id, sum(least(rc, pc)) AS overlap, sum(rc) AS n_ref, sum(pc) AS n_pred FROM j GROUP BY 1)
, pr AS (SELECT pairs.record_id, coalesce(overlap, 0) / greatest(coalesce(n_pred, 0), 1) AS p,
                coalesce(overlap, 0) / greatest(coalesce(n_ref, 0), 1) AS r FROM pairs LEFT JOIN per USING (record_id))
, r1 AS (SELECT record_id, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS score_rouge1 FROM pr)
"""


# Characters of the prediction that match nothing: the 7s and the blank of an added part.
_EDITS = _BASE + """
, ed AS (SELECT record_id, length(reference_text) AS n_ref, length(prediction_text) AS n_pred,
                (length(prediction_text) - length(replace(prediction_text, '7', '')))
                + CASE WHEN prediction_text LIKE '7 %' OR prediction_text LIKE '% 777' THEN 1 ELSE 0 END AS alien FROM pairs)
, lev AS (SELECT record_id, CAST(alien AS DOUBLE) AS score_levenshtein_distance,
                 2.0 * (n_pred - alien) / (n_ref + n_pred) AS score_levenshtein_ratio FROM ed)
, lt AS (SELECT record_id, count(*) FILTER (WHERE side = 'ref') AS tr, count(*) FILTER (WHERE side = 'pred') AS tp,
                count(*) FILTER (WHERE side = 'pred' AND token NOT LIKE '%7%') AS tl FROM tok GROUP BY 1)
, rl AS (SELECT pairs.record_id, CASE WHEN coalesce(tr, 0) = 0 OR coalesce(tp, 0) = 0 OR tl = 0 THEN 0.0
                ELSE 2 * (tl / tp) * (tl / tr) / ((tl / tp) + (tl / tr)) END AS score_rougeL FROM pairs LEFT JOIN lt USING (record_id))
"""


@register("levenshtein_distance", oracle=_EDITS + "SELECT record_id, score_levenshtein_distance FROM lev")
def levenshtein_distance(spark, sf_dir):
    return X.levenshtein_distance(pairs(spark, sf_dir))


@register("levenshtein_ratio", oracle=_EDITS + "SELECT record_id, score_levenshtein_ratio FROM lev")
def levenshtein_ratio(spark, sf_dir):
    return X.lcs_scores(pairs(spark, sf_dir)).select("record_id", "score_levenshtein_ratio")


@register("rougeL", oracle=_EDITS + "SELECT record_id, score_rougeL FROM rl")
def rougeL(spark, sf_dir):
    return X.lcs_scores(pairs(spark, sf_dir)).select("record_id", "score_rougeL")


@register("rouge1", oracle=_BASE + "SELECT * FROM r1")
def rouge1(spark, sf_dir):
    return X.rouge1(pairs(spark, sf_dir))


@register("content_scores_all_rows", oracle=_BASE + """
SELECT i.record_id, i.gt_type, i.pred_type, r1.score_rouge1 FROM items i LEFT JOIN r1 USING (record_id)""")
def content_scores_all_rows(spark, sf_dir):
    """O-52: scores return to every item; rows that are not scorable keep NULL."""
    it = items(spark, sf_dir)
    return it.join(X.rouge1(X.scorable(it)), "record_id", "left").select("record_id", "gt_type", "pred_type", "score_rouge1")


@register("content_scores_wide", oracle=_EDITS + """
SELECT i.record_id, i.gt_type, i.pred_type, score_levenshtein_distance, score_levenshtein_ratio, score_rougeL, score_rouge1
FROM items i LEFT JOIN lev USING (record_id) LEFT JOIN rl USING (record_id) LEFT JOIN r1 USING (record_id)""")
def content_scores_wide(spark, sf_dir):
    return X.content_scores(items(spark, sf_dir), ["rouge", "levenshtein"]).drop("reference_text", "prediction_text")


@register("greedy_embedding_match", oracle=rounded_sql("WITH v AS (" + fixture_sql("token_vecs") + """)
, ref AS (SELECT * FROM v WHERE side = 'ref'), pred AS (SELECT * FROM v WHERE side = 'pred')
, bp AS (SELECT p.record_id, p.pos, max(list_cosine_similarity(CAST(p.vec AS DOUBLE[]), CAST(r.vec AS DOUBLE[]))) AS m
         FROM pred p JOIN ref r USING (record_id) GROUP BY 1, 2)
, br AS (SELECT r.record_id, r.pos, max(list_cosine_similarity(CAST(r.vec AS DOUBLE[]), CAST(p.vec AS DOUBLE[]))) AS m
         FROM ref r JOIN pred p USING (record_id) GROUP BY 1, 2)
, pp AS (SELECT record_id, avg(m) AS score_bert_precision FROM bp GROUP BY 1)
, rr AS (SELECT record_id, avg(m) AS score_bert_recall FROM br GROUP BY 1)
SELECT record_id, score_bert_precision, score_bert_recall,
       CASE WHEN score_bert_precision + score_bert_recall > 0
            THEN 2 * score_bert_precision * score_bert_recall / (score_bert_precision + score_bert_recall) ELSE 0.0 END AS score_bert_f1
FROM pp JOIN rr USING (record_id)""", ["record_id", "score_bert_precision", "score_bert_recall", "score_bert_f1"],
    {"score_bert_precision", "score_bert_recall", "score_bert_f1"}))
def greedy_embedding_match(spark, sf_dir):
    return round_doubles(X.greedy_embedding_match(fixture(spark, sf_dir, "token_vecs")))
