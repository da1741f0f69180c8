"""Samples for classifiers, long lines, and training by blocks."""

import numpy as np
import pyarrow as pa
import pytest

from lendlens.llm import common, language, toxicity


def test_sample_keeps_text_and_label_of_one_row(spark):
    docs = spark.createDataFrame([(1, "zz text", "de"), (1, "a text", "en"), (1, "bb", None), (2, None, "fr"), (None, "x", "en")],
                                 "doc_id long, text string, lang string")
    found = common.labelled_texts(docs, None, "lang", 10, 1 << 20)
    assert sorted(zip(found.texts.to_pylist(), found.labels)) == [("", "fr"), ("a text", "en")]
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, None), (3, 1), (None, 1)], "doc_id long, toxic int")
    found = common.labelled_texts(docs, labels, "toxic", 10, 1 << 20)
    assert (found.texts.to_pylist(), found.labels) == (["bb"], [1])
    assert common.labelled_texts(docs.limit(0), labels, "toxic", 10, 1 << 20).labels == []


def test_sample_is_bounded_by_rows_and_bytes(spark):
    rows = [(i, "x" * 100, 1) for i in range(50)] + [(7, "x" * 100, 1)] * 400 + [(100, "y" * 5000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic")
    assert len(common.labelled_texts(docs, labels, "toxic", 60, 1600).texts) == 16  # repeats of an id count once
    assert len(common.labelled_texts(docs, labels, "toxic", 20, 1 << 20).texts) == 20
    assert len(common.labelled_texts(docs, labels, "toxic", 60, 1 << 20).texts) == 51


@pytest.mark.parametrize("labels", [2, 5])
def test_long_lines_in_pieces(labels, monkeypatch):
    rng = np.random.default_rng(labels)
    sizes = np.array([1, 40, 7, 700, 8, 16, 129])
    emission = rng.normal(size=(sizes.sum(), labels)) * 4
    move, first = rng.normal(size=(labels, labels)) * 2, rng.normal(size=labels)
    whole = language.marginals(emission, sizes, move, first)[0]
    monkeypatch.setattr(language, "ABREAST", 8)
    assert np.allclose(language.line_marginals(emission, sizes, move, first), whole, atol=1e-10)


def test_signs_that_are_no_letters():
    model = language.fit([("ein wort und noch eins", "de"), ("one word and another", "en")])
    names, score = model.predict(pa.array(["½ ² Ⅷ ①", "½ a", "", "日本"]))
    assert names[0] == names[2] == "und" and score[0] == 0
    assert names[1] in ("de", "en") and names[3] in ("de", "en")


def test_split_in_blocks():
    texts = pa.array(["a b a", None, "", "b  c\td " + "word " * 300_000, "a z"])
    codes, starts, words = common.split_many(texts)
    one, begins, spelled = common.split_words(texts.fill_null(""))
    assert (starts == begins).all()
    assert words.take(pa.array(codes)).equals(spelled.take(pa.array(one)))


def test_gradients_by_blocks_equal_the_whole(monkeypatch):
    rng = np.random.default_rng(9)
    sizes = rng.integers(1, 6, 30)
    ptr, slot = np.concatenate([[0], np.cumsum(sizes)]), rng.integers(0, 12, sizes.sum()).astype(np.int32)
    window_of = np.sort(rng.integers(0, 9, 80)).astype(np.int32)
    word_of = rng.integers(0, 30, 80)
    vectors, error = rng.normal(size=(12, 3)), rng.normal(size=(9, 3))
    spread = np.zeros((9, 12))  # share of each bucket in each window
    for w, v in zip(window_of, word_of):
        for s in slot[ptr[v]:ptr[v + 1]]:
            spread[w, s] += 1 / sizes[v] / toxicity.WINDOW
    for block in (4, 1 << 14):
        monkeypatch.setattr(toxicity, "WORD_BLOCK", block)
        monkeypatch.setattr(toxicity, "WINDOW_BLOCK", block)
        bags = toxicity.Bags(toxicity.Spelling(ptr, slot), word_of, window_of, 9)
        assert np.allclose(bags.forward(vectors), spread @ vectors, atol=1e-6)
        assert np.allclose(bags.backward(error, 12), spread.T @ error, atol=1e-6)
