"""What the driver holds: short plans, no forgotten frames."""

import random

import numpy as np

from scorecraft.llm import components, jaccard_join, linear, storage, substring_dedup


def planned(monkeypatch, module) -> list[int]:
    """Tables and held frames in the plan of each frame that ``module`` writes from now on."""
    seen, cut = [], storage.cut

    def counted(df, *args, **kwargs):
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen.append(plan.count("FileScan ") + plan.count("InMemoryRelation ") + plan.count("Scan ExistingRDD"))
        return cut(df, *args, **kwargs)

    monkeypatch.setattr(module, "cut", counted)
    return seen


def test_names_do_not_repeat_the_plans_below_them(spark, monkeypatch):
    storage.release()
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    shared = noise(700)
    texts = [noise(200) + shared + noise(100 + 50 * i) for i in range(6)] + [noise(900), shared[:450], None]
    seen = planned(monkeypatch, substring_dedup)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substring_dedup.digest(substring_dedup.remove(docs)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == substring_dedup.brute_force([(t or "").encode() for t in texts])
    assert max(seen) <= 80
    storage.release()


def test_a_round_of_stars_has_short_plans(spark, monkeypatch):
    storage.release()
    seen = planned(monkeypatch, components)
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21), (21, 20), (22, 22)], "a long, b long")
    got = {(r.node, r.component) for r in components.components(edges).collect()}
    assert got == {(i, 0) for i in range(10)} | {(20, 20), (21, 20)}
    assert max(seen) <= 15
    storage.release()


def test_one_of_each_gives_back_what_it_held(spark):
    storage.release()
    words = [f"w{i}" for i in range(120)]
    texts = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join([*words[:60], "x", *words[60:]])), (4, "a b c d e f"), (5, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = jaccard_join.one_of_each(docs, words=3, near=80)
    assert not storage._held and len(storage._written) == 1
    assert sorted(r.doc_id for r in out.collect()) == [1, 4, 5]
    storage.release()


def test_frames_that_others_have_unpersisted_are_forgotten(spark):
    storage.release()
    first, second = storage.hold(spark.range(3)), storage.hold(spark.range(4).selectExpr("id + 1 AS x"))
    assert len(storage._held) == 2 and first.count() + second.count() == 7
    spark.catalog.clearCache()
    third = storage.hold(spark.range(5).selectExpr("id * 2 AS y"))
    assert len(storage._held) == 1 and storage._held[0] is third and third.count() == 5
    storage.release()


def test_tables_are_given_back_with_held_frames(spark):
    storage.release()
    table, other = storage.cut(spark.range(3)), storage.cut(spark.range(2))
    storage.let_go(table, storage.hold(spark.range(6).selectExpr("id - 1 AS z")))
    assert not storage._held and [t for t, _ in storage._written] == [other] and other.count() == 2
    storage.release()


def test_the_sample_leaves_no_arrow_memory_behind(spark, monkeypatch):
    given = []
    monkeypatch.setattr(linear, "give_back", lambda: given.append(1))
    docs = spark.createDataFrame([(i, f"some words and {i % 3} more", i % 2) for i in range(30)], "doc_id long, text string, quality int")
    starts, bucket, value, labels, _ = linear.featurise(docs, linear.Features(bits=8), ["quality"])
    assert given == [1] and len(starts) == 31 and len(bucket) == len(value) == starts[-1]
    assert np.bincount(labels["quality"].astype(int)).tolist() == [15, 15]
