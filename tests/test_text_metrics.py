"""Text metrics against brute force (O-69..O-73): the plans without a DuckDB
oracle are checked here on whole texts of the smallest driver tables."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scorecraft.functions.lcs import edit_distance, lcs_length
from scorecraft.operators import text_metrics as X
from scorecraft.plans import text_plans

SF_SMALL = "/root/testdata/sf0.001"


def dp_lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if x == y else max(prev[j], cur[j - 1]))
        prev = cur
    return prev[-1]


def dp_edit(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def tokens(t):
    return [x for x in re.sub(r"[^a-z0-9]+", " ", t.lower()).split() if x]


def f1(p, r):
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def test_bit_parallel_matches_dp():
    import random
    rnd = random.Random(7)
    for _ in range(500):
        a = "".join(rnd.choice("abé ") for _ in range(rnd.randint(0, 60)))
        b = "".join(rnd.choice("abé ") for _ in range(rnd.randint(0, 60)))
        assert lcs_length(a, b) == dp_lcs(a, b)
        assert edit_distance(a, b) == dp_edit(a, b)


def test_plans_against_brute_force(spark):
    pairs = text_plans.pairs(spark, SF_SMALL).collect()
    assert pairs
    want = {}
    for r in pairs:
        a, b = r.reference_text, r.prediction_text
        ta, tb = tokens(a), tokens(b)
        lcs_t = dp_lcs(ta, tb)
        p = lcs_t / len(tb) if ta and tb else 0.0
        rr = lcs_t / len(ta) if ta and tb else 0.0
        ov = sum((Counter(ta) & Counter(tb)).values())
        want[r.record_id] = (dp_edit(b, a), 2 * dp_lcs(a, b) / (len(a) + len(b)), f1(p, rr),
                             f1(ov / max(len(tb), 1), ov / max(len(ta), 1)))
    got_d = {r.record_id: r.score_levenshtein_distance for r in text_plans.levenshtein_distance(spark, SF_SMALL).collect()}
    got_r = {r.record_id: r.score_levenshtein_ratio for r in text_plans.levenshtein_ratio(spark, SF_SMALL).collect()}
    got_l = {r.record_id: r.score_rougeL for r in text_plans.rougeL(spark, SF_SMALL).collect()}
    got_1 = {r.record_id: r.score_rouge1 for r in text_plans.rouge1(spark, SF_SMALL).collect()}
    wide = {r.record_id: r for r in text_plans.content_scores_wide(spark, SF_SMALL).collect()}
    for k, (d, ratio, rl, r1) in want.items():
        assert got_d[k] == d
        assert math.isclose(got_r[k], ratio, abs_tol=1e-12)
        assert math.isclose(got_l[k], rl, abs_tol=1e-12)
        assert math.isclose(got_1[k], r1, abs_tol=1e-12)
        assert wide[k].score_levenshtein_distance == d


def test_code_points(spark):
    df = spark.createDataFrame([("r1", "é", "e"), ("r2", "", "abc")], "record_id string, reference_text string, prediction_text string")
    assert {r.record_id: r.score_levenshtein_distance for r in X.levenshtein_distance(df).collect()} == {"r1": 1.0, "r2": 3.0}


def test_identity_scores_one(spark):
    df = spark.createDataFrame([("r", "The cat sat. The cat!", "The cat sat. The cat!")],
                               "record_id string, reference_text string, prediction_text string")
    r = X.lcs_scores(df).collect()[0]
    assert r.score_levenshtein_ratio == 1.0 and r.score_rougeL == 1.0 and r.score_levenshtein_distance == 0.0
    assert X.rouge1(df).collect()[0].score_rouge1 == 1.0


def test_rouge1_is_multiset(spark):
    df = spark.createDataFrame([("r", "a a b", "a b b")], "record_id string, reference_text string, prediction_text string")
    # clipped overlap: min(2,1) + min(1,2) = 2 of 3 on each side
    assert math.isclose(X.rouge1(df).collect()[0].score_rouge1, 2 / 3)


def test_greedy_embedding_match(spark):
    v = spark.createDataFrame([(1, "ref", 0, [1.0, 0.0]), (1, "ref", 1, [0.0, 1.0]), (1, "pred", 0, [1.0, 0.0])],
                              "record_id long, side string, pos int, vec array<float>")
    r = X.greedy_embedding_match(v, block=1).collect()[0]
    assert r.score_bert_precision == pytest.approx(1.0) and r.score_bert_recall == pytest.approx(0.5)
    assert r.score_bert_f1 == pytest.approx(2 / 3)


def test_unknown_family_raises(spark):
    df = spark.createDataFrame([("r", "nlp", "nlp", "a", "b")],
                               "record_id string, gt_type string, pred_type string, reference_text string, prediction_text string")
    with pytest.raises(ValueError):
        X.content_scores(df, ["rouge", "nope"])
    out = X.content_scores(df, ["rouge"]).collect()[0]
    assert out.score_rouge1 == 0.0


def test_embedding_match_by_brute_force_over_many_blocks_and_batches(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    tokens = {}
    for record, n_ref, n_pred in (("a", 40, 7), ("b", 1, 1), ("c", 13, 30), ("only ref", 4, 0)):
        tokens[record] = {"ref": rng.normal(size=(n_ref, 6)), "pred": rng.normal(size=(n_pred, 6))}
    tokens["a"]["ref"][3] = 0                                    # a zero vector matches nothing
    rows = [(r, side, i, x.tolist()) for r, t in tokens.items() for side, xs in t.items() for i, x in enumerate(xs)]
    rows += [("a", "pred", 100, None), ("none", "ref", 0, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(str(r), str(s), int(i), v) for r, s, i, v in rows], "record_id string, side string, pos int, vec array<double>")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {r.record_id: r for block in (4,) for r in X.greedy_embedding_match(df.repartition(5), block).collect()}
        whole = {r.record_id: r for r in X.greedy_embedding_match(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert set(got) == set(whole) == {*tokens, "none"}
    for record, t in tokens.items():
        p = r = 0.0
        if len(t["pred"]):
            unit = {k: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1) for k, x in t.items()}
            cosines = unit["pred"] @ unit["ref"].T
            p, r = cosines.max(axis=1).mean(), cosines.max(axis=0).mean()
        for x in (got[record], whole[record]):
            assert abs(x.score_bert_precision - p) < 1e-12 and abs(x.score_bert_recall - r) < 1e-12
    assert got["none"].score_bert_f1 == 0.0


def test_rouge1_by_counters(spark):
    from collections import Counter

    pairs = [(0, "la la la", "la la"), (1, "", "x"), (2, "a b c", "c b a d"), (3, None, "a"), (4, "z", "z"), (5, "q", "")]
    got = {r.record_id: r.score_rouge1 for r in X.rouge1(spark.createDataFrame(
        pairs, "record_id int, reference_text string, prediction_text string")).collect()}
    for i, ref, pred in pairs:
        a, b = Counter((ref or "").split()), Counter((pred or "").split())
        both = sum((a & b).values())
        p, r = both / max(1, sum(b.values())), both / max(1, sum(a.values()))
        assert abs(got[i] - (2 * p * r / (p + r) if p + r else 0.0)) < 1e-12
