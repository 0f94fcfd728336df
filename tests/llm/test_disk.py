"""What the operators leave on disk while they run."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorecraft.llm import jaccard_join as J
from scorecraft.llm import storage, stored


def shuffle_files(spark) -> set[str]:
    """Those with more than the few bytes of a count."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = [files.apply(i) for i in range(files.size())]
    return {f.getName() for f in found if f.getName().startswith("shuffle_") and f.length() > 500}


def documents(spark, n: int = 60):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = {}
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.choice([4, 30, 90, 200]))
        texts[2 * i] = " ".join(words)
        words[rng.randrange(len(words))] = "other"
        texts[2 * i + 1] = " ".join(words)
    texts[1000], texts[1001], texts[1002] = None, "", texts[4]
    return texts, spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def test_a_written_table_leaves_no_shuffle_files(spark):
    storage.release()
    before, setting = shuffle_files(spark), spark.conf.get(storage.CLEANUP, None)
    table = storage.cut(spark.range(5_000).repartition(3).filter("id % 7 = 0"))
    assert not shuffle_files(spark) - before and table.count() == 715
    assert spark.conf.get(storage.CLEANUP, None) == setting
    storage.release()


def test_held_frames_keep_their_shuffle_files(spark):
    storage.release()
    held = storage.hold(spark.range(5_000).withColumn("g", F.col("id") % 7).repartition(3, "g"))
    assert held.count() == 5_000
    there = shuffle_files(spark)
    table = storage.cut(held.groupBy("g").count().join(held.select("g").distinct(), "g"))
    assert shuffle_files(spark) & there and table.count() == 7
    persisted = spark.sparkContext._jsc.getPersistentRDDs()
    for key in list(persisted):
        persisted[key].unpersist(True)                       # as if executors were lost: made again from the shuffle
    assert held.count() == 5_000
    storage.release()


def test_the_setting_comes_back_after_a_failure(spark):
    setting = spark.conf.get(storage.CLEANUP, None)
    with pytest.raises(ZeroDivisionError), storage.swept(spark):
        assert spark.conf.get(storage.CLEANUP) == "true"
        1 / 0
    assert spark.conf.get(storage.CLEANUP, None) == setting


def test_the_jaccard_join_holds_neither_texts_nor_parts(spark, monkeypatch):
    storage.release()
    kinds, hold = [], storage.hold

    def seen(df):
        kinds.extend(t for _, t in df.dtypes)
        return hold(df)

    for module in (J, stored):
        monkeypatch.setattr(module, "hold", seen)
    texts, docs = documents(spark)
    before = shuffle_files(spark)
    kept = J.one_of_each(docs, words=3, near=80)
    assert kinds and set(kinds) <= {"bigint", "int", "boolean"}      # a few numbers a row
    assert not shuffle_files(spark) - before
    groups = J.brute_force(texts, 3, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in groups.values()})
    storage.release()


def test_parts_of_a_slice_link_the_sets_that_share_any():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lists = [np.unique(rng.integers(1, 60, rng.integers(0, 5))) for _ in range(25)]
        lists[7] = lists[3]
        node = np.arange(100, 125).astype(np.uint64)
        node[7] = node[3]                                    # equal sets are one node
        ends = np.r_[0, np.cumsum([len(x) for x in lists])]
        a, sig = J.slice_parts(np.concatenate(lists).astype(np.uint64), ends, node)
        assert len(a) == len(sig)

        def groups(pairs):
            found = J.Union(200)
            first = {}
            for x, s in pairs:
                found.join(int(x), first.setdefault(s, int(x)))
            return found.roots()[100:125].tolist()

        assert groups(zip(a.tolist(), sig.tolist())) == groups([(node[i], s) for i, x in enumerate(lists) for s in x.tolist()])
    empty = J.slice_parts(np.zeros(0, np.uint64), np.zeros(3, np.int64), np.arange(2).astype(np.uint64))
    assert [len(x) for x in empty] == [0, 0]


def test_a_common_part_is_shuffled_once_a_slice():
    node, n = np.arange(1, 301).astype(np.uint64), 300
    sig = np.tile(np.arange(50).astype(np.uint64), n)        # 300 sets with the same 50 parts
    a, _ = J.slice_parts(sig, np.arange(n + 1) * 50, node)
    assert len(a) == 50 + 2 * (n - 1)


def test_too_few_parts_lead_to_another_seed(spark, monkeypatch):
    storage.release()
    real = J.signatures
    seeds, parts = [], J._parts
    monkeypatch.setattr(J, "signatures", lambda h, off, near, seed: (*real(h, off, near, seed)[:2], seed == 0))
    monkeypatch.setattr(J, "_parts", lambda docs, words, near, seed: seeds.append(seed) or parts(docs, words, near, seed))
    texts, docs = documents(spark, 20)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link(docs, 3, 80).collect()}
    assert got == J.brute_force(texts, 3, 80) and seeds == [0, 1]
    storage.release()
