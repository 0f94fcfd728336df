"""Edit-aware counts, merge-dropout pieces and the corpus pipeline."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from scorecraft.llm import merge_dropout as M
from scorecraft.llm import queries as Q
from scorecraft.llm import token_counts as T

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "   ", "▁x ▁▁ y", "\U0001f600 a  b\t\tc", "  a b\n\nÉté x  ", "x" * 3000 + " " * 50, "don't  stop\r\n  now"]


@pytest.fixture(scope="module")
def count():
    encode = T.encoder(T.load_ranks()).encode_ordinary
    return lambda t: len(encode(t))


def test_trees_follow_edits(count):
    random.seed(2)
    letters = "ab  c'sd1 .\n\té  "
    for _ in range(400):
        t = "".join(random.choice(letters) for _ in range(random.choice([0, 1, 5, 50, 400])))
        pieces = T.cut_text(t, 7)
        assert "".join(pieces) == t
        tree = T.SegmentTree.build([(len(p), count(p)) for p in pieces])
        assert tree.tokens[1] == count(t)
        for _ in range(2):
            places = sorted(random.sample(range(len(t) + 1), min(len(t) + 1, random.choice([2, 4, 6]))))
            edits = [(a, b, "".join(random.choice(letters) for _ in range(random.randint(0, 9))))
                     for a, b in zip(places[::2], places[1::2])]
            expected = t
            for a, b, r in reversed(edits):
                expected = expected[:a] + r + expected[b:]
            t, _ = T.apply_edits(t, tree, edits, count)
            assert t == expected and tree.chars[1] == len(t) and tree.tokens[1] == count(t)


def test_only_touched_leaves_are_encoded(count):
    text = " ".join(f"word{i}" for i in range(20_000))
    tree = T.SegmentTree.build([(len(p), count(p)) for p in T.cut_text(text)])
    new, done = T.apply_edits(text, tree, [(90_000, 90_003, "new words")], count)
    assert done < 4 * T.LEAF and tree.tokens[1] == count(new)


def test_state_and_update(spark, count):
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate([*ODD, None, ODD[5]])],
                                 "doc_id int, text string, n_tokens int")
    state = T.build(docs.withColumn("edits", T.sample_edits(F.col("doc_id"), F.col("text"))))
    for r in state.collect():
        assert r.n_tokens == (None if r.text is None else count(r.text))
    for r in T.update(state).collect():
        assert r.n_tokens == (None if r.text is None else count(r.text))
    same = T.update(T.build(docs).withColumn("edits", F.lit(None).cast(T.EDIT))).collect()
    assert [r.text for r in sorted(same, key=lambda r: r.doc_id)] == [*ODD, None, ODD[5]]
    assert T.build(docs.limit(0)).count() == 0


def test_counts_query(spark, count):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").withColumn(
        "e", T.sample_edits(F.col("doc_id"), F.col("text"))).collect()}
    got = Q.op3_token_counts(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        text = docs[r.doc_id].text
        assert r.n_tokens_before == count(text)
        for s, e, new in sorted((tuple(x) for x in docs[r.doc_id].e), reverse=True):
            text = text[:s] + new + text[e:]
        assert (r.n_tokens, r.n_chars) == (count(text), len(text))


def test_pieces_both_ways_and_model():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=M.MODEL)
    vocab = M.vocabulary()
    plain, varied = M.Coder(vocab, 0.0), M.Coder(vocab, 0.2)
    texts = [*ODD, "internationalization of several words", "la la la la"]
    for i, t in enumerate(texts):
        if t and "▁" not in t:
            assert plain.encode(" " + t, i) == sp.encode(t)
        for coder in (plain, varied):
            ids = coder.encode(t, i)
            assert ids == coder.encode_by_heap(t, i) and coder.decode(ids) == t
    assert len({tuple(varied.encode("internationalization of several words", i)) for i in range(30)}) > 2
    assert M.Coder(vocab, 0.2, seed=5).encode(texts[-2], 1) != varied.encode(texts[-2], 1)
    assert M.Coder(vocab, 1.0).encode("abc", 0) == [vocab["ids"][vocab["names"].index(c)] for c in "abc"]


def test_dropout_gives_more_pieces_of_prose(spark):
    """Over a table of prose; in a single odd text greedy merges need not be the fewest."""
    vocab = M.vocabulary()
    coders = [M.Coder(vocab, rate) for rate in (0.0, 0.1, 0.2)]
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    few, more, most = (sum(len(c.encode(t, i)) for i, t in texts) for c in coders)
    assert few < more < most


def test_every_occurrence_has_its_own_coins():
    vocab = M.vocabulary()
    coder, word = M.Coder(vocab, 0.2), " internationalization"
    whole = coder.encode(word * 400, 3)
    assert whole == coder.encode_by_heap(word * 400, 3) and coder.decode(whole) == word * 400
    cuts, piece = set(), []
    for i in whole:                                          # the document's pieces, word by word
        if piece and vocab["values"][i].startswith(b" "):
            cuts.add(tuple(piece))
            piece = []
        piece.append(i)
    assert len(cuts) > 12
    assert len({tuple(coder.encode(word, i)) for i in range(400)}) > 12


def test_pieces_of_a_table(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*ODD, None])], "doc_id int, text string, pieces string")
    rows = {r.doc_id: r for r in M.with_pieces(docs).collect()}
    assert all(r.lossless for r in rows.values() if r.text is not None)
    assert rows[len(ODD)].pieces is None and rows[0].pieces == []
    back = {r.doc_id: r.text for r in M.decode(M.encode(docs)).collect()}
    assert [back[i] for i in range(len(ODD) + 1)] == [*ODD, None]
    assert M.encode(docs.limit(0)).count() == 0


def test_pieces_query(spark):
    got = Q.op7_merge_dropout(spark, SF).collect()
    coder = M.Coder(M.vocabulary())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(docs) and all(r.lossless and r.n_pieces == len(r.pieces) for r in got)
    assert all(coder.decode(r.pieces) == docs[r.doc_id] for r in got)


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        rows = docs.collect()
        assert docs.columns[: len(columns)] == columns and (i == 4 or len(docs.columns) == len(columns))
        after = {r.doc_id: r.text for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name == "n-gram Jaccard join":
            from scorecraft.llm import jaccard_join as J
            groups = J.brute_force(before, 5, 80)
            assert set(after) == {i for i, (_, c) in groups.items() if i == c}
        elif name == "suffix-array dedup":
            from scorecraft.llm import substring_dedup as S
            expected = dict(zip(before, S.brute_force([t.encode() for t in before.values()], corpus_pipeline.PASSAGE)))
            assert {i: len(before[i].encode()) - expected[i][1] for i in before} == {i: len(t.encode()) for i, t in after.items()}
        elif name == "quality classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            good = [i for i in before if labels.get(i) == 1]
            assert sum(i in after for i in good) > 0.95 * len(good) and len(after) < len(before)
        else:
            assert set(after) == set(before)
        assert all(len(after[i]) <= len(texts[i]) for i in after)
    assert docs.filter("NOT lossless").count() == 0


def test_pipeline_query_is_registered(spark):
    assert E.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in E.oracle_sql()
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "pieces" in out.columns


def test_pipeline_on_odd_rows(spark, tmp_path):
    t = " ".join(f"word{i} and" for i in range(60))
    rows = [(1, t, "en", "a", len(t)), (2, t, None, None, None), (2, t, None, None, None), (None, None, None, None, None),
            (4, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, SF)
            path = str(tmp_path / f"{random.random()}")
            frame.write.parquet(path)
            frame = spark.read.parquet(path)
        assert "pieces" in frame.columns


def test_book_of_segmentations_changes_no_piece():
    import numpy as np

    vocab = M.vocabulary()
    words = "internationalization banana la the several segmentations of ordinary words \u00e9t\u00e9".split()
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(words, 400)) for _ in range(12)]
    kept, fresh = M.Coder(vocab, 0.3), M.Coder(vocab, 0.3, book=0)
    for i, t in enumerate(texts):
        ids = kept.encode(t, i)
        assert ids == fresh.encode(t, i) == M.Coder(vocab, 0.3).encode(t, i) and kept.decode(ids) == t
    assert kept.encode_by_heap(texts[0], 0) == kept.encode(texts[0], 0)
    assert kept.book.names.n > fresh.book.names.n            # the one remembers, the other began anew
    assert kept.encode("", 1) == [] and kept.encode(texts[3], 3) == fresh.encode(texts[3], 3)


def test_pair_table_finds_each_merge_and_no_other():
    import numpy as np

    vocab = M.vocabulary()
    table = M.Merges(vocab["keys"], vocab["merged"])
    piece, ok = table.find(vocab["keys"])
    assert ok.all() and (piece == vocab["merged"]).all()
    others = np.random.default_rng(1).integers(0, len(vocab["names"]) ** 2, 50_000)
    piece, ok = table.find(others.reshape(100, 500))
    assert (ok.ravel() == np.isin(others, vocab["keys"])).all()
    assert not M.Merges(vocab["keys"][:0], vocab["merged"][:0]).find(others)[1].any()


def test_pieces_do_not_depend_on_slices():
    """Slices are small, as a worker's memory follows them, and cut nothing."""
    import numpy as np

    from scorecraft.llm import batches, merge_dropout

    assert merge_dropout.SLICE <= batches.SLICE_BYTES
    texts = [f"number {i} of the repeated words, words and words {i % 3}".encode() for i in range(40)]
    off = np.r_[0, np.cumsum([len(t) for t in texts])]
    data, ids = np.frombuffer(b"".join(texts), np.uint8), list(range(40))
    vocab = merge_dropout.vocabulary(merge_dropout.MODEL)
    whole, bounds = merge_dropout.Coder(vocab).encode_slice(data, off, ids)
    coder = merge_dropout.Coder(vocab)
    parts = [coder.encode_slice(data[off[i]: off[i + 8]], off[i: i + 9] - off[i], ids[i: i + 8])[0] for i in range(0, 40, 8)]
    assert np.concatenate(parts).tolist() == whole.tolist() and len(bounds) == 41
