"""Odd rows, large alphabets and hot groups; verdicts recomputed from their evidence."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scorecraft.llm import hot, jaccard_join, langid, linear, merge_dropout, site_quality, storage, substring_dedup, toxicity
from scorecraft.llm.components import components

SF = "/root/testdata/sf0.001"


def test_every_letter_has_a_symbol():
    """A language of 5,000 letters beside two small ones: phrases by brute force, and it wins."""
    rng = np.random.default_rng(1)
    large = ["".join(chr(0x4E00 + int(c)) for c in np.sort(rng.integers(0, 5000, 6))) for _ in range(1500)]
    references = {"large": " ".join(large), "one": "ab ba abba " * 300, "two": "cd dc cddc " * 300}
    model = langid.LanguageModel(references)
    assert model.symbols > 4000 and model.width == langid.DENSE + 2
    texts = [" ".join(random.Random(i).choices(large, k=20)) for i in range(5)] + ["abba cd ba", "cddc", chr(0x4E00) * 3]
    cost, letter = model.costs(texts)
    assert [model.langs[b] for b in cost.argmin(axis=0)[:5]] == ["large"] * 5 and letter.all()
    for row, lang in enumerate(model.langs):
        symbols = langid.to_symbols(references[lang], model.table).tolist()
        held = "".join(map(chr, symbols))
        for col, text in enumerate(texts):
            s, phrases, i = "".join(map(chr, langid.to_symbols(text, model.table).tolist())), 0, 0
            while i < len(s):
                n = 1
                while i + n < len(s) and s[i: i + n + 1] in held:
                    n += 1
                phrases, i = phrases + 1, i + n
            assert cost[row, col] == pytest.approx(phrases * np.log2(max(2, len(symbols))) / len(s))


@pytest.mark.parametrize("length", [130, 250, 400])
def test_removal_at_any_length(spark, length):
    random.seed(length)
    pool = ["".join(random.choice("abcde ") for _ in range(random.randint(100, 600))) for _ in range(5)]
    texts = ["".join(random.choice(pool)[random.randint(0, 60):] for _ in range(random.randint(0, 3))) for _ in range(25)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.digest(substring_dedup.remove(df, length)).collect()}
    assert [got[i] for i in range(25)] == substring_dedup.brute_force([t.encode() for t in texts], length)


def test_many_equal_rows_share_their_ranges(spark):
    """10,000 equal rows: one set of ranges for all, not one for each."""
    random.seed(3)
    text = "".join(random.choice("abcdefgh") for _ in range(1500))
    df = spark.range(10_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    stored, settled = substring_dedup.repeats(df)
    assert settled.groupBy("k").agg(F.collect_set("at").alias("ats")).select(F.max(F.size("ats"))).first()[0] < 1500
    out = substring_dedup.digest(substring_dedup.remove(df)).groupBy("n_removed").count().collect()
    assert [tuple(r) for r in out] == [(1500, 10_000)]


def test_a_row_keeps_its_own_verdict(spark, monkeypatch):
    """Rows without an id, and rows that share one, are kept or dropped each by its own text."""
    docs = spark.createDataFrame([(None, "good a", "s", "en"), (None, "bad b", "s", "en"), (7, "good c", "s", "en"),
                                  (7, "bad d", "s", "en"), (7, "bad d", "s", "en"), (None, None, None, None)],
                                 "doc_id long, text string, source string, lang string")
    monkeypatch.setattr(site_quality, "classify", lambda d, labels, carried: d.select(
        "doc_id", *carried, F.coalesce(F.col("text").startswith("good"), F.lit(False)).alias("kept")))
    got = corpus_pipeline.quality_classifier(spark, docs, SF)
    assert got.columns == docs.columns and sorted(r.text for r in got.collect()) == ["good a", "good c"]


def test_one_row_of_each_group_stays(spark):
    t, u = (" ".join(f"{c}{i}" for i in range(60)) for c in "tu")
    rows = [(5, t, 1), (5, u, 2), (9, t + " end", 3), (8, u + " end", 4), (None, t, 5), (6, "no", 6), (6, "no", 7), (4, None, 8), (4, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, c int")
    got = [sorted((r.doc_id or -1, r.text) for r in jaccard_join.one_of_each(df.repartition(n)).collect() if r.text) for n in (1, 4)]
    assert got[0] == got[1] == [(-1, t), (4, ""), (5, t), (5, u), (6, "no")][:1] + [(5, t), (5, u), (6, "no")]
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns and kept.filter("doc_id = 4").count() == 2


def test_regions_split_again_and_again(spark):
    """Chains of near sets in one region that a single split does not make small."""
    random.seed(5)
    texts, words = {}, [f"w{i}" for i in range(100)]
    for i in range(150):
        words = list(words)
        words[random.randrange(100)] = f"n{i}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link(df, 3, 90, most_docs=8).collect()}
    assert got == jaccard_join.brute_force(texts, 3, 90)


def test_joins_of_hot_keys(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("a"), "id")
    counts = rows.groupBy("a").agg(F.count("*").alias("n"), F.min("id").alias("m"))
    got = hot.join_counted(rows, counts.filter("a <> 999"), ["a"], 1000)
    assert got.columns == ["a", "id", "m"] and got.count() == 999
    star = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert components(star).filter("component = 0").count() == 3000


def test_samples_with_repeated_ids(spark):
    """An id on many rows is one row of the sample, whatever their order."""
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(300)] + [(2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (1, 1)], "doc_id long, quality int")
    got = [sorted((r.doc_id, r.text) for r in linear.sample(docs.repartition(n), labels, 10, ["quality"]).collect()) for n in (1, 5)]
    assert got[0] == got[1] and [r[0] for r in got[0]] == [1, 2]
    texts = docs.join(labels.withColumnRenamed("quality", "lang").withColumn("lang", F.lit("x")), "doc_id")
    assert len(langid.fit(texts).langs) == 1


def test_ids_of_coins():
    ids = [0, (1 << 61) - 1, -1, "a", "b", None, 5]
    assert len({merge_dropout.number_of(i) for i in ids[:-2]}) == 5 and merge_dropout.number_of(5) == 5


def test_posteriors_by_brute_force(spark):
    """The site posterior of every row recomputed from the evidence rows."""
    rng = np.random.default_rng(7)
    rows = [(i, f"h{int(rng.integers(4)) if i % 3 else 0}", f"p{int(rng.integers(3))}", float(rng.random()), float(rng.normal())) for i in range(200)]
    known = {i: int(rng.integers(2)) for i in range(0, 200, 4)}
    evidence = spark.createDataFrame(rows, "doc_id long, host string, path string, p_doc double, ratio double")
    labels = spark.createDataFrame(list(known.items()), "doc_id long, quality int")
    good = {r[0]: float(known.get(r[0], r[3])) for r in rows}
    hosts, paths = {}, {}
    for i, h, p, _, _ in rows:
        hosts.setdefault(h, []).append(good[i])
        paths.setdefault((h, p), []).append(good[i])
    n, total = len(rows), sum(good.values())
    rate, strength = site_quality.prior_of(total, n, len(hosts), sum(sum(v) ** 2 / len(v) for v in hosts.values()),
                                           float(sum(len(v) ** 2 for v in hosts.values())))
    for r in site_quality.posteriors(evidence, labels).collect():
        _, h, p, _, ratio = rows[r.doc_id]
        own, host, path = good[r.doc_id], hosts[h], paths[h, p]
        host_rate = (sum(host) - own + strength * rate) / (len(host) - 1 + strength)
        site = (sum(path) - own + strength * host_rate) / (len(path) - 1 + strength)
        logit = np.log(site / (1 - site)) + ratio
        assert (r.host_n, r.path_n) == (len(host), len(path))
        assert r.site_rate == pytest.approx(site) and r.posterior == pytest.approx(1 / (1 + np.exp(-logit)))


def test_chain_by_brute_force(spark):
    """Every link of the chain evaluated word by word."""
    import re

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, toxicity.with_low_quality(labels), ["low_quality", "toxic"])
    texts = [(r.doc_id, r.text) for r in docs.limit(40).collect()] + [(-1, ""), (-2, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.predict(df, chain).collect()}
    from scorecraft.llm.batches import Powers
    powers = Powers()
    for i, text in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        buckets = set()
        for w in set(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)):
            raw = np.frombuffer(w.encode(), np.uint8)
            h = powers.spans(powers.prefix(raw), np.array([0]), np.array([len(raw)]))[0]
            buckets.add(int(h >> np.uint64(64 - toxicity.FEATURES.bits)))
        earlier = []
        for link in chain:
            weight = dict(zip(link["at"].tolist(), link["w"].tolist()))
            z = sum(weight.get(b, 0.0) for b in buckets) + float(np.dot(earlier, link["v"])) + link["bias"]
            earlier.append(float(np.clip(link["a"] * z + link["b"], -8, 8)))
            p = 1 / (1 + np.exp(-earlier[-1]))
            assert got[i][f"p_{link['category']}"] == pytest.approx(p, abs=1e-9)
            assert got[i][f"is_{link['category']}"] == (p >= toxicity.THRESHOLD)


def test_scopes_and_folders(spark, monkeypatch):
    storage.release()
    out = storage.settled(lambda: storage.cut(storage.hold(spark.range(5)).selectExpr("id * 2 AS x")).selectExpr("x + 1 AS x"))
    assert not storage._held and len(storage._written) == 1 and out.count() == 5
    storage.release()
    assert not storage._written

    class Cluster:
        sparkContext = type("C", (), {"master": "spark://host:7077", "getCheckpointDir": lambda self: None})()
        conf = type("D", (), {"get": lambda self, *a: None})()

    with pytest.raises(ValueError):
        storage.ready(Cluster())
