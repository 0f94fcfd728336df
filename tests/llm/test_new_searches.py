"""Hard negatives, line dedup and spelling groups against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorecraft.llm import hard_negatives as H
from scorecraft.llm import line_dedup as L
from scorecraft.llm import queries as Q
from scorecraft.llm import spelling as S

SF = "/root/testdata/sf0.001"


def mined(df, label="label", every=10):
    q = H.quantised(df, label)
    got = sorted(map(tuple, H.mine(q, F.col("id") % every == 0).collect()), key=str)
    rows = [(None if r.id == H.NO_ID else r.id, r.label, r.vec) for r in q.collect()]
    return got, H.brute_force(rows, lambda i: i % every == 0)


def test_mining_with_nulls_repeats_ties_and_odd_lengths(spark):
    """Null ids, labels, vectors and components, NaN, empty and short vectors, many ties,
    ids with several rows, repeated rows, a clashing column."""
    random.seed(1)
    vectors = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf")]]
    vectors += [[random.choice([0.5, -1.0, 2.0]) for _ in range(random.randint(1, 6))] for _ in range(30)]
    rows = [(random.choice([None, i, i, i // 2]), random.choice([1, 2, None, 1]), random.choice(vectors), i) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:40], "vec_id long, label int, embedding array<float>, rank int")
    got, expected = mined(df)
    assert got == expected and len(got) > 200
    assert mined(df.limit(0)) == ([], [])


def test_one_common_vector_and_large_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(3)), (rng.normal(size=8) * 1e4).tolist() if i % 3 else [2e4, 1.0] * 4) for i in range(1500)]
    got, expected = mined(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), every=100)
    assert got == expected and len(got) > 50


def test_boxes_bound_their_rows_and_packing_keeps_all():
    x = np.random.default_rng(4).integers(-300, 300, (1000, 12))
    order = H.str_order(x)
    assert sorted(order.tolist()) == list(range(1000))
    lo, hi = H.boxes(x[order], H.LEAF)
    for i, r in enumerate(x[order]):
        assert (lo[i // H.LEAF] <= r).all() and (r <= hi[i // H.LEAF]).all()


def test_queue_leaves_boxes_unread(monkeypatch):
    """Clustered vectors: most leaves are pruned, the result is that of all."""
    rng = np.random.default_rng(5)
    corner = lambda i: np.r_[np.array([i % 4, i // 4 % 4, i // 16]) * 300, np.zeros(13, int)]
    x = np.concatenate([rng.integers(-5, 5, (32, 16)) + corner(31 - i) for i in range(32)])
    anchor = H.Anchors([{"id": np.array([-1]), "key": np.array([0]), "label": np.array([0]), "vec": x[:1],
                         "low": np.array([[H.LEAST]]), "high": np.array([[H.NO_ID]])}])
    best, read = H.Best(anchor.low, anchor.high, 5), []
    monkeypatch.setattr(H.Best, "add", lambda self, *a, f=H.Best.add: (read.append(1), f(self, *a)))
    x = x[H.str_order(x)]
    H.search_page(anchor, np.array([0]), best, np.arange(len(x)), np.zeros(len(x), int), x, True)
    scores = x @ anchor.vec[0]
    assert best.score[0, 0].tolist() == sorted(scores.tolist(), reverse=True)[:5] and len(read) < 12


def test_mining_query(spark):
    got = Q.op11_hard_negatives(spark, SF)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert sorted(map(tuple, got.collect()), key=str) == mined(e, label, 100)[1]


POOL = [f"  Long line number {i} of the pool é\t" for i in range(30)] + ["short", "", "\x0b x ", "LONG line NUMBER 3 of the pool é", "x" * 19, "é" * 20]


def line_texts():
    random.seed(2)
    some = [None, "", "\n", "\n\n"] + ["\n".join(random.choice(POOL) for _ in range(random.randint(0, 12))) for _ in range(20)]
    rows = [(random.choice([None, i, i, i, i // 3]), random.choice(some)) for i in range(80)]
    return rows + [(1000, None)] * 2 + [(7, rows[7][1])] * 3 + [(2000, "\n".join(POOL * 20_000))]


@pytest.mark.parametrize("bits", [5, 14])
def test_lines_by_brute_force(spark, bits):
    """Few bits make every line a suspect; the result is the same.  Null ids and texts, rows
    that share an id, repeated rows, a text of 20 MB, a clashing column."""
    texts = line_texts()
    df = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, kept int")
    got = sorted(map(tuple, L.digest(L.dedup(df, bits=bits)).collect()), key=str)
    assert got == sorted(L.brute_force(texts), key=str)
    assert sum(r[2] for r in got) > 200
    assert L.dedup(df.limit(0), bits=bits).count() == 0


def test_hot_and_rare_keys_by_either_join(spark, monkeypatch):
    texts = [(i, "one line that all documents hold\nanother one, held by few %d" % (i // 4)) for i in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for hot in (1, 20, 100_000):
        monkeypatch.setattr(L, "HOT", hot)
        assert sorted(map(tuple, L.digest(L.dedup(df, bits=16)).collect())) == sorted(L.brute_force(texts))


def test_filters_of_many_tasks(spark):
    """A key held by two documents is never cleared, wherever they are; most others are."""
    rows = [(i, f"a line of its own with the number {i}\nshared by two of them, number {i % 500}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = L.suspects(L.keyed(df), L.suspects_filter(df, bits=18), L.CHARS)
    assert found.filter("line = 1").count() == 1000 and found.filter("line = 0").count() < 50


def test_line_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, Q.op12_line_dedup(spark, SF).collect())) == sorted(L.brute_force(rows))


def spelling_texts():
    random.seed(6)
    base = ["".join(random.choice("abcéü") for _ in range(random.randint(4, 8))) for _ in range(12)]

    def edited(w):
        i = random.randrange(len(w))
        return random.choice([w, w, w, w[:i] + w[i + 1:], w[:i] + random.choice("abcdZ") + w[i:], w[:i] + "b" + w[i + 1:]])

    texts = [(random.choice([None, i, i, i // 2]), random.choice([" ", "-", "1", "Ā", "\n"]).join(edited(random.choice(base))
              for _ in range(random.randint(0, 60)))) for i in range(60)]
    texts.append((50, "chainone " * 30 + "chainonx " * 12 + "chainoyx " * 4))
    return texts + [(1, None), (2, ""), (3, "×÷Àÿ" * 2 + " ¿" * 9)] + [(5, texts[5][1])] * 2 + [(9, "longrun" * 3000 + " abcab" * 90_000)]


@pytest.mark.parametrize("block", [S.BLOCK, 3])
def test_spelling_by_brute_force(spark, monkeypatch, block):
    """Blocks of three words make every cell several blocks."""
    monkeypatch.setattr(S, "BLOCK", block)
    texts = spelling_texts()
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, word string")
    got = [tuple(r) for r in S.group(df).collect()]
    assert len(got) == len(set(got)) and set(got) == S.brute_force(texts)
    assert any(r[2] != r[0] and r[2] != r[1] for r in got)          # a chain of forms
    assert S.group(df.limit(0)).count() == 0


def test_crc_of_spans():
    import zlib

    data = np.random.default_rng(8).integers(0, 256, 5000).astype(np.uint8)
    start = np.array([0, 10, 200, 4000, 7])
    end = np.array([3, 10, 4300, 4064, 71])
    seeds = np.array([zlib.crc32(str(i).encode()) for i in range(5)], np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(s)) for a, b, s in zip(start, end, seeds)]
    assert S.crcs(data, start, end, seeds).tolist() == want


def test_spelling_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {tuple(r) for r in Q.op13_spelling_groups(spark, SF).collect()} == S.brute_force(rows)
