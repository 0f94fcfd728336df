"""Language ID, quality rules, site quality and toxicity."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorecraft.llm import langid, linear, quality_rules, site_quality, toxicity
from scorecraft.llm import queries as Q
from scorecraft.llm.batches import Powers

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "12 34 !!"), (5, "the " * 30_000), (5, "the " * 30_000)]


def cross_parse(reference: str, text: str) -> int:
    phrases, i = 0, 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i: i + n + 1] in reference and text[i] in reference:
            n += 1
        phrases, i = phrases + 1, i + n
    return phrases


def test_phrases_by_brute_force():
    random.seed(4)
    for _ in range(30):
        refs = {lang: "".join(random.choice("abc ") for _ in range(60)) for lang in ("x", "y")}
        model = langid.LanguageModel(refs)
        texts = ["".join(random.choice("abcd ") for _ in range(random.randint(1, 90))) for _ in range(5)]
        cost, letter = model.costs(texts)
        for i, t in enumerate(texts):
            plain = re.sub("[^a-z]+", " ", t)
            assert letter[i] == bool(re.search("[a-z]", t))
            for j, lang in enumerate(model.langs):
                ref = re.sub(" +", " ", refs[lang])
                size = len(langid.to_symbols(refs[lang], model.table))
                expected = cross_parse(ref, plain) * np.log2(size) / len(plain)
                assert cost[j, i] == pytest.approx(expected)


def test_language_query(spark):
    got = Q.op1_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    both = got.join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(both) == docs.count()
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()
    test = both[both.held_out]
    assert (test.lang == test.lang_pred).mean() > 0.97
    assert both.score.between(0, 1).all()


def test_language_edge_cases(spark):
    docs = spark.createDataFrame(ODD, "doc_id int, text string").withColumn("score", F.lit("clash"))
    learn = spark.createDataFrame([(7, "the cat and the dog", "en"), (8, "le chat et le chien", "fr"), (9, "x", None)],
                                  "doc_id int, text string, lang string")
    rows = langid.predict(docs, langid.fit(learn)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.lang_pred == ("en" if r.doc_id == 5 else "und") and 0 <= r.score <= 1
    none = langid.predict(docs, langid.fit(learn.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def base_by_hand(text: str | None) -> tuple:
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    window: dict = {}
    for i in range(len(words) - 7):
        window.setdefault(tuple(words[i: i + 8]), []).append(i)
    hit = {j for at in window.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit),
            n < 20 or 100 * len(hit) > 30 * n)


def test_base_signals_by_hand(spark):
    random.seed(6)
    texts = [t for _, t in ODD] + ["a b\na b\n\nc", "é ü#\x0b<|>\n\n x\n x"]
    for _ in range(40):
        words = random.choices(["a", "bb", "é", "c#"], k=random.randint(0, 60))
        texts.append("".join(w + random.choice([" ", "\n", "  ", "\t"]) for w in words))
    texts.append(" ".join(f"w{i % 9}" for i in range(50)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("kept", F.lit(1))
    model = (np.zeros(quality_rules.FEATURES.size, np.float32), 0.0, 3.0)
    got = {r.doc_id: r for r in quality_rules.apply(df, model).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_by_hand(t)
        assert r.kept == (not r.base_failed)
    assert quality_rules.apply(df.limit(0), model).count() == 0


def test_quality_query_matches_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = Q.op2_quality_rules(spark, SF).toPandas().set_index("doc_id")
    for r in docs.limit(60).collect():
        g = got.loc[r.doc_id]
        assert tuple(int(x) for x in g[:5]) + (bool(g.base_failed),) == base_by_hand(r.text)
    both = labels.toPandas().set_index("doc_id").join(got)
    good = both[(both.quality == 1) & ~both.base_failed]
    assert good.kept.mean() > 0.95
    assert not both[both.quality == 0].kept.mean() > 0.3


def test_models_without_labels(spark):
    docs = spark.createDataFrame(ODD, "doc_id int, text string").withColumn("source", F.lit(None).cast("string")) \
        .withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([], "doc_id int, quality int, toxic int")
    assert {r.kept for r in site_quality.classify(docs, labels).collect()} == {True}
    assert quality_rules.apply(docs, quality_rules.fit(docs, labels)).count() == len(ODD)
    chain = toxicity.fit(docs, toxicity.with_low_quality(labels), ["low_quality", "toxic"])
    assert {r.is_toxic for r in toxicity.predict(docs, chain).collect()} == {False}
    assert toxicity.predict(docs.limit(0), chain).count() == 0


def test_prior_by_moments():
    rate, strength = site_quality.prior_of(50, 100, 2, 40 ** 2 / 50 + 10 ** 2 / 50, 2 * 50 ** 2)
    assert rate == 0.5 and strength == site_quality.SMALLEST_STRENGTH
    assert site_quality.prior_of(50, 100, 2, 2 * 25 ** 2 / 50, 2 * 50 ** 2)[1] == site_quality.LARGEST_STRENGTH
    assert site_quality.prior_of(0, 0, 0, 0, 0)[0] == 0.5


def test_sparse_sites_shrink(spark):
    """A path with one bad document stays nearer to its host than one with many."""
    rows = [(i, "a", "x", 0.9, 0.0) for i in range(50)] + [(100 + i, "b", "x", 0.1, 0.0) for i in range(50)]
    rows += [(200, "a", "thin", 0.1, 0.0), (201, "a", "thin", 0.9, 0.0)]
    evidence = spark.createDataFrame(rows, "doc_id int, host string, path string, p_doc double, ratio double")
    none = spark.createDataFrame([], "doc_id int, quality int")
    got = {r.doc_id: r for r in site_quality.posteriors(evidence, none).collect()}
    assert got[100].site_rate < 0.3 < 0.7 < got[0].site_rate
    assert got[100].site_rate < got[201].site_rate < got[0].site_rate      # one bad neighbour
    assert len(got) == len(rows)


def test_site_query_keeps_clean_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    both = Q.op4_quality_classifier(spark, SF).join(labels, "doc_id").toPandas()
    assert both[both.quality == 1].kept.mean() > 0.97
    assert both[both.quality == 0].kept.mean() < 0.3


def test_toxicity_query(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = Q.op8_toxicity(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    both = got.join(labels, "doc_id").toPandas()
    assert both[both.toxic == 1].is_toxic.mean() > 0.7
    assert both[both.toxic == 0].is_toxic.mean() < 0.02


def test_toxicity_held_out(spark):
    """Trained on two thirds of the labels, judged on the rest."""
    large = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{large}/{t}.parquet") for t in ("documents", "labels"))
    labels = toxicity.with_low_quality(labels)
    chain = toxicity.fit(docs, labels.filter("doc_id % 3 > 0"), ["low_quality", "toxic"])
    assert len(chain[1]["v"]) == 1 and len(chain[0]["v"]) == 0
    test = toxicity.predict(docs, chain).join(labels.filter("doc_id % 3 = 0"), "doc_id").toPandas()
    assert test[test.toxic == 0].is_toxic.mean() < 0.01
    assert test[test.toxic == 1].is_toxic.mean() > 0.6


def test_linear_scores_equal_training_decisions():
    """Scoring text gives what the trained rows give."""
    texts = ["good text here", "bad bad", "good good words", ""]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
    for f in (linear.Features(words=(1, 2), chars=(3,), bits=10), linear.Features(words=(1,), bits=10, mean=False)):
        w = np.random.default_rng(1).normal(size=f.size)
        expected = np.zeros(4)
        for doc, bucket in f.pairs(data, off, Powers()):
            for d in range(4):
                own = bucket[doc == d]
                if len(own):
                    expected[d] += w[own].mean() if f.mean else w[np.unique(own)].sum()
        assert np.allclose(f.scores(data, off, w, Powers()), expected)


def test_calibration_is_monotone_and_sane():
    rng = np.random.default_rng(0)
    z = rng.normal(size=2000)
    y = (rng.random(2000) < linear.sigmoid(3 * z + 1)).astype(float)
    a, b = linear.calibrate(z, y)
    assert a == pytest.approx(3, abs=0.5) and b == pytest.approx(1, abs=0.4)
    assert linear.calibrate(z, np.ones(2000)) == (1.0, 0.0)
