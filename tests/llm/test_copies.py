"""Jaccard join, substring removal and decontamination against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorecraft.llm import decontamination as D
from scorecraft.llm import jaccard_join as J
from scorecraft.llm import queries as Q
from scorecraft.llm import substring_dedup as S

SF = "/root/testdata/sf0.001"
WORDS = [f"W{i}" for i in range(60)]


def near_copies(seed: int, n: int) -> dict:
    random.seed(seed)
    base = [[random.choice(WORDS) for _ in range(random.choice([3, 9, 12, 30, 60, 150]))] for _ in range(8)]
    texts: dict = {}
    for i in range(n):
        w = list(random.choice(base))
        for _ in range(random.randint(0, 3)):
            w[random.randrange(len(w))] = random.choice(WORDS)
        texts[i] = (" " if i % 2 else "\n").join(w[random.randint(0, 4):] or w if random.random() < 0.3 else w)
    for extra in (None, "", "a", "A b", "a  b", "  "):
        texts[len(texts)] = extra
    return texts


@pytest.mark.parametrize("most_docs, words, near", [(J.REGION_DOCS, 3, 90), (12, 3, 90), (J.REGION_DOCS, 5, 80)])
def test_join_by_brute_force(spark, most_docs, words, near):
    texts = near_copies(5, 110)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link(df, words, near, most_docs=most_docs).collect()}
    assert got == J.brute_force(texts, words, near)


def test_region_cells_by_brute_force():
    """Pivots and windows inside a region lose no link."""
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(6):
        base = rng.choice(1 << 40, 40, replace=False)
        for _ in range(30):
            keep = rng.random(40) > rng.choice([0, 0.03, 0.08])
            sets.append(np.unique(np.r_[base[keep], rng.choice(1 << 40, rng.integers(0, 4))]).astype(np.uint64))
    roots = J.join_region(sets, 90, cell=16)
    _, both, union = J.distances(sets, sets)
    comp = np.arange(len(sets))
    linked = 100 * both >= 90 * union
    while True:
        new = np.array([comp[linked[i]].min() for i in range(len(sets))])
        new = new[new]
        if (new == comp).all():
            break
        comp = new
    assert (roots == comp).all()


@pytest.mark.parametrize("near", [80, 90])
def test_linked_sets_share_a_signature(near):
    """Whatever the sizes and the seed, small sets included."""
    rng = np.random.default_rng(9)
    pairs = 0
    for trial in range(800):
        a = np.unique(rng.integers(0, 1 << 60, int(rng.integers(4, 150)))).astype(np.uint64)
        kept = a[rng.random(len(a)) > 0.2 * rng.random()]
        new = rng.integers(0, 1 << 60, int(rng.integers(0, len(a) // 5 + 1)) if trial % 2 else 0).astype(np.uint64)
        b = np.unique(np.r_[kept, new])
        both, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * both < near * union or both == union:
            continue
        pairs += 1
        sig, off, short = J.signatures(np.r_[a, b], np.r_[0, len(a), len(a) + len(b)], near, trial % 5)
        assert not short and len(np.intersect1d(sig[: off[1]], sig[off[1]:])) >= 1
    assert pairs > 100


def test_null_ids_repeats_and_clashing_columns(spark):
    t = " ".join(f"x{i}" for i in range(40))
    rows = [(None, t, 1), (5, t, 2), (5, t, 2), (7, t + " end", 3), (9, None, 4), (None, "other words in here", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.component_id) for r in J.link(df).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (7, 5), (9, 9), (None, 5)], key=str)
    kept = J.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1 for r in kept.collect())) == [-1, -1, 5, 9]
    assert J.link(df.limit(0)).count() == 0


def test_ids_with_several_texts_lose_no_link(spark):
    def near(name):
        t = " ".join(f"{name}{i}" for i in range(60))
        return t, t + " end"

    (a, a2), (b, b2), (c, c2) = near("a"), near("b"), near("c")
    rows = [(5, a), (5, b), (20, b), (30, b2), (40, a2), (None, c), (None, "no " + b), (50, c2), (60, c2 + " x"), (70, "alone here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in J.link(df).collect() if r.doc_id is not None))
    assert got == [(5, 5), (5, 5), (20, 5), (30, 5), (40, 5), (50, 50), (60, 50), (70, 70)]
    # Classes of rows without an id alone meet in their own regions.
    nulls = spark.createDataFrame([(None, a), (None, b), (None, c), (1, a2), (2, b2), (3, c2)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in J.link(nulls).collect()) == [(0, 1)] * 3 + [(1, 1), (2, 2), (3, 3)]
    # Links that only a shared class can show: 20 and 30 are near, id 5 has both texts' class first.
    rows = [(5, a), (5, b), (4, a2), (20, b), (30, b2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in J.link(df).collect()) == [(4, 4), (5, 4), (5, 4), (20, 4), (30, 4)]


def pasted(seed: int) -> list[str]:
    random.seed(seed)

    def rnd(n):
        return "".join(random.choice("abcdé ") for _ in range(n))

    pool, texts = [rnd(random.randint(300, 900)) for _ in range(6)], []
    for _ in range(40):
        parts = [random.choice(pool + [rnd(random.randint(0, 500))] * 4) for _ in range(random.randint(0, 4))]
        texts.append("".join(p[random.randint(0, 80):] if random.random() < 0.5 else p for p in parts))
    return texts + ["ab " * 500, "", "x" * 401, "y" * 400, texts[3], texts[3]]


@pytest.mark.parametrize("texts", [pasted(3), pasted(8), [""], ["é" * 200, "é" * 200]])
def test_removal_by_brute_force(spark, texts):
    df = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string").withColumn("kept", F.lit(0))
    got = {r.doc_id: tuple(r)[1:] for r in S.digest(S.remove(df)).collect()}
    expected = S.brute_force([t.encode() for t in texts])
    assert got.pop(None)[:3] == (0, 0, 0)
    assert [got[i] for i in range(len(texts))] == expected


def test_rows_that_share_an_id(spark):
    random.seed(1)
    a = "".join(random.choice("abcdef") for _ in range(500))
    df = spark.createDataFrame([(1, a), (1, "short"), (2, a[50:] + "zz")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in S.digest(S.remove(df)).collect())
    assert got == [(1, 5, 0), (1, 500, 450), (2, 452, 450)]
    assert S.remove(df.limit(0)).count() == 0


def test_many_texts_without_an_id(spark):
    """More of them than 16 bits of hash can tell apart."""
    random.seed(4)

    def rnd(n):
        return "".join(random.choice("abcdef") for _ in range(n))

    passage = rnd(430)
    texts = [rnd(random.randint(0, 60)) + passage[random.randint(0, 20):] + rnd(random.randint(0, 30)) for _ in range(1500)]
    df = spark.createDataFrame([(None if i % 8 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(tuple(r)[1:] for r in S.digest(S.remove(df)).collect())
    assert got == sorted(S.brute_force([t.encode() for t in texts]))


def test_cleaned_texts(spark):
    random.seed(2)
    a = "".join(random.choice("abcdef") for _ in range(500))
    rows = [(1, "head " + a, "en", 505), (2, a + " tail", None, 505), (3, None, "en", None), (None, "é", "fr", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: tuple(r)[1:] for r in S.clean(df).collect()}
    assert got == {1: ("head ", "en", 5), 2: (" tail", None, 5), 3: (None, "en", None), None: ("é", "fr", 1)}


def contaminated_by_hand(docs: list, items: list) -> list[tuple]:
    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    out = []
    for d in docs:
        w, hit, found = words(d), set(), set()
        for i, t in items:
            p = words(t)
            for j in range(max(1, len(p) - 9) if p else 0):
                q = p[j: j + 10]
                for k in range(len(w) - len(q) + 1):
                    if w[k: k + len(q)] == q:
                        hit |= set(range(k, k + len(q)))
                        found.add(str(i))
        out.append((len(w), len(hit), len(found), D.items_sha256(list(found)), bool(hit)))
    return out


@pytest.mark.parametrize("seed, block_bytes", [(1, D.BLOCK_BYTES), (2, 1), (3, D.BLOCK_BYTES)])
def test_decontamination_by_hand(spark, seed, block_bytes):
    random.seed(seed)
    pool = ["a", "B", "été", "x1", "-", "Z."][: random.choice([3, 6])]
    items = [(i, " ".join(random.choices(pool, k=random.randint(0, 14)))) for i in range(7)] + [(70, None), (71, items_same := "a B a")]
    items.append((72, items_same))
    docs = [" ".join(random.choices(pool + ["rare"], k=random.choice([0, 3, 40, 300]))) for _ in range(25)]
    docs += [None, "", "a" * 5000, docs[3], docs[3]]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string").withColumn("items", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id int, text string")
    found = D.find(df, bench, block_bytes)
    got = {r.doc_id: tuple(r)[1:] for r in D.digest(found).collect()}
    assert [got[i] for i in range(len(docs))] == contaminated_by_hand(docs, items)
    clean = {r.doc_id: r.text for r in D.clean(df, bench, block_bytes).collect()}
    for i, d in enumerate(docs):
        if not got[i][4]:
            assert clean[i] == d
        else:
            assert len(clean[i]) < len(d)
    assert D.find(df.limit(0), bench).count() == 0
    assert D.digest(D.find(df, bench.limit(0))).filter("contaminated").count() == 0


def test_rows_of_one_id_against_several_blocks(spark):
    """Rows that share an id, or have none, are treated one by one whatever the number of blocks."""
    item, other = " ".join(f"w{i}" for i in range(12)), " ".join(f"v{i}" for i in range(11))
    rows = [(1, "é " * 9 + item + " end"), (1, "ö" * 40), (1, None), (None, other + " x"), (None, "é" * 50), (None, "plain words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, other), (3, "w3 " + other)], "item_id int, text string")
    one, many = ([sorted(map(str, f(df, bench, size).collect())) for f in (D.find, D.clean)] for size in (D.BLOCK_BYTES, 1))
    assert one == many and len(one[0]) == len(rows)
    texts = [t for _, t in rows]
    texts[0], texts[3] = "é " * 9 + " end", " x"
    assert sorted(str(r.text) for r in D.clean(df, bench, 1).collect()) == sorted(map(str, texts))


def test_queries_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in Q.op5_benchmark_decontamination(spark, SF).collect()}
    assert [got[r.doc_id] for r in docs] == contaminated_by_hand([r.text for r in docs], items)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op6_jaccard_join(spark, SF).collect()}
    assert got == J.brute_force({r.doc_id: r.text for r in docs})
    got = {r.doc_id: tuple(r)[1:] for r in Q.op10_substring_dedup(spark, SF).collect()}
    assert [got[r.doc_id] for r in docs] == S.brute_force([r.text.encode() for r in docs])


def test_shared_parts_need_little_more_than_the_sets():
    import tracemalloc

    import numpy as np

    from scorecraft.llm import jaccard_join

    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    sets = [np.unique(np.r_[rng.choice(pool, 20), rng.integers(0, 1 << 64, 580, dtype=np.uint64)]) for _ in range(700)]
    tracemalloc.start()
    parts = jaccard_join.shared_parts(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * sum(map(len, sets))
    held = [set(s.tolist()) for s in sets]
    assert (jaccard_join.intersections(parts[:30], parts[30:90])
            == [[len(a & b) for b in held[30:90]] for a in held[:30]]).all()
    assert all((np.diff(p) > 0).all() for p in parts)


def test_parts_are_shuffled_once(spark):
    """Near copies still meet, in and across tasks, and no count of the parts goes before."""
    from scorecraft.llm import jaccard_join

    words = [f"w{i}" for i in range(300)]
    texts = {i: " ".join(words[:200] + [f"x{i}"] + words[200:]) for i in range(12)} | {20: " ".join(words[::-1]), 21: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link(docs).collect()}
    assert got == jaccard_join.brute_force(texts)


def test_workers_give_memory_back(monkeypatch):
    from scorecraft.llm import batches

    given = []
    monkeypatch.setattr(batches, "give_back", lambda: given.append(1))
    run = batches.lean(lambda rows: (2 * r for r in rows))
    assert list(run(iter([1, 2]))) == [2, 4] and given == [1]


def test_one_of_each_moves_whole_texts_once(spark):
    """The rows that stay come from the copy the join works on, with all their columns."""
    def text(name, n=80):
        return " ".join(f"{name}{i}" for i in range(n))

    t = text("t")
    rows = [(1, t, 1, "k"), (2, t + " end", 2, None), (3, text("é"), 3, "l"), (None, t, 4, "m"), (None, None, None, None), (4, None, 5, "n"),
            (4, "", 6, "o"), (6, text("u"), 7, "p"), (6, text("u"), 8, "q"), (6, text("u"), 8, "q"), (6, text("v"), 9, "r")]
    df = spark.createDataFrame(rows, "doc_id int, text string, k int, `a b` string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")             # as where the keys are too many to be broadcast
    try:
        kept = J.one_of_each(df, words=3, near=80)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, kept.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert kept.columns == df.columns and [f.dataType for f in kept.schema] == [f.dataType for f in df.schema]
    one = [r for r in got if r[1] == text("u")]
    assert len(one) == 1 and one[0] in rows
    assert [r for r in got if r not in one] == sorted([r for r in rows if r[:2] != (2, t + " end") and r[1] != text("u")], key=str)
    assert "Join" not in plan and plan.count("Exchange") <= 1
