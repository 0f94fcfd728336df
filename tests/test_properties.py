"""Property tests."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorecraft.functions.lcs import edit_distance, lcs_length
from scorecraft.plans import label_plans, tool_plans

SF_SMALL = "/root/testdata/sf0.001"
text = st.text(alphabet="abcé xyz", max_size=40)


@settings(max_examples=300, deadline=None)
@given(text, text)
def test_lcs_and_edit_bounds(a, b):
    lcs = lcs_length(a, b)
    assert 0 <= lcs <= min(len(a), len(b))
    assert lcs_length(b, a) == lcs
    d = edit_distance(a, b)
    assert abs(len(a) - len(b)) <= d <= max(len(a), len(b))
    assert edit_distance(b, a) == d
    assert (d == 0) == (a == b)
    if a or b:
        ratio = 2 * lcs / (len(a) + len(b))
        assert 0.0 <= ratio <= 1.0
        assert (ratio == 1.0) == (a == b)


@settings(max_examples=200, deadline=None)
@given(text, text, text)
def test_edit_distance_triangle(a, b, c):
    assert edit_distance(a, c) <= edit_distance(a, b) + edit_distance(b, c)


def test_tool_score_implications(spark):
    wide = tool_plans.tool_scores_wide(spark, SF_SMALL)
    both = wide.filter((F.col("gt_type") == "tool") & (F.col("pred_type") == "tool")).collect()
    assert both
    for r in both:
        for c in wide.columns[3:]:
            v = r[c]
            assert v is None or 0.0 <= v <= 1.0 or c.endswith(("hallucination_rate", "additional_rate"))
        # one gt call with catalogued arguments: an exact match scores every argument correct
        if r.score_exact_match == 1.0:
            assert r.score_variable_correct_rate == 1.0
            assert r.score_tool_pick_up_rate == 1.0
        if r.score_variable_pickup_rate is not None:
            assert r.score_variable_pickup_rate >= r.score_variable_correct_rate
    others = wide.filter(~((F.col("gt_type") == "tool") & (F.col("pred_type") == "tool"))).collect()
    assert all(r.score_exact_match is None and r.score_tool_pick_up_rate is None for r in others)


def test_confusion_totals(spark):
    m = label_plans.guardrail_comparison(spark, SF_SMALL).collect()
    for r in m:
        assert r.true_positives + r.false_positives + r.false_negatives + r.true_negatives == r.num_samples


def test_order_invariance_of_text_scores(spark):
    from scorecraft.operators import text_metrics as X
    from scorecraft.plans import text_plans
    pairs = text_plans.pairs(spark, SF_SMALL)
    a = sorted(map(tuple, X.lcs_scores(pairs).collect()))
    b = sorted(map(tuple, X.lcs_scores(pairs.repartition(7).orderBy(F.rand(3))).collect()))
    assert a == b
