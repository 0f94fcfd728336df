"""Pre-processing: records, quarantines, context, last user query (O-11..O-21)."""

from pyspark.sql import functions as F

from scorecraft.operators import records as R

SCHEMA = "category string, conv_id long, uid string, turn_idx long, role string, content string, tool_calls string"


def turns(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def sample(spark):
    return turns(spark, [
        # sample 1: user, assistant(call), tool, assistant, user (dangling)
        ("complete", 1, "u1", 0, "user", "show spending", None),
        ("complete", 1, "u1", 1, "assistant", None, '{"name": "show_pie_chart"}'),
        ("complete", 1, "u1", 2, "tool", "data", None),
        ("complete", 1, "u1", 3, "assistant", "here", None),
        ("complete", 1, "u1", 4, "user", "thanks", None),
        # sample 2: too short
        ("nlp", 2, "u2", 0, "user", "hi", None),
        # sample 3: user, assistant
        ("nlp", 3, "u3", 0, "user", "hello", None),
        ("nlp", 3, "u3", 1, "assistant", "hey", None),
    ])


def test_prediction_records(spark):
    recs = R.prediction_records(sample(spark))
    got = sorted((r.record_id, r.trigger_role, r.gt_turn_index, r.gt_role, r.gt_type, r.n_context)
                 for r in recs.collect())
    assert got == [
        ("complete:1:0", "user", 1, "assistant", "tool", 1),
        ("complete:1:2", "tool", 2, "tool", "nlp", 3),
        ("nlp:3:0", "user", 1, "assistant", "nlp", 1),
    ]


def test_quarantines(spark):
    t = sample(spark)
    _, short = R.split_short_samples(t)
    assert [(r.category, r.conv_id, r.n_messages) for r in short.collect()] == [("nlp", 2, 1)]
    dangling = R.dangling_user_turns(t).collect()
    assert [(r.conv_id, r.turn_idx) for r in dangling] == [(1, 4)]


def test_rewrite_and_context(spark):
    t = sample(spark)
    rw = {r.turn_idx: (r.role, r.content) for r in R.rewrite_turns(t).filter("conv_id = 1").collect()}
    assert rw[1] == ("assistant", '<tool_call>{"name": "show_pie_chart"}</tool_call>')
    assert rw[2] == ("user", "<tool_response>data</tool_response>")
    recs = R.prediction_records(t)
    ctx = {r.record_id: r.context for r in R.materialise_context(recs, t, "SYS").collect()}
    c = ctx["complete:1:2"]
    assert [m.role for m in c] == ["system", "user", "assistant", "user"]
    assert c[0].content == "SYS" and c[-1].content == "<tool_response>data</tool_response>"
    # unchanged when the template has tool tokens
    assert R.rewrite_turns(t, True).filter("role = 'tool'").count() == 1


def test_last_user_query(spark):
    t = sample(spark)
    recs = R.prediction_records(t)
    q = {r.record_id: r.query for r in R.last_user_query(recs, t).collect()}
    assert q["complete:1:0"] == "show spending"
    # the rewritten tool turn is the last user message of its own context
    assert q["complete:1:2"] == "<tool_response>data</tool_response>"
    q2 = {r.record_id: r.query for r in R.last_user_query(recs, t, template_has_tool_token=True).collect()}
    assert q2["complete:1:2"] == "show spending"


def test_running_max_blocked_matches_window(spark):
    from pyspark.sql import Window
    from scorecraft.functions.windows import running_max_blocked
    df = spark.range(0, 500).select(F.lit("k").alias("k"), F.col("id").alias("pos"),
                                    F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    got = running_max_blocked(df, ["k"], "pos", F.col("v"), "m", block=16)
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("m", F.max("v").over(w))
    assert sorted(map(tuple, got.select("pos", "m").collect())) == sorted(map(tuple, want.select("pos", "m").collect()))


def test_head_per_category(spark):
    t = sample(spark)
    kept = R.head_per_category(t, 1).select("category", "conv_id").distinct().collect()
    assert sorted((r.category, r.conv_id) for r in kept) == [("complete", 1), ("nlp", 2)]
    assert R.head_per_category(t, 0).count() == t.count()
