"""The labelled sample of language identification among copies and long texts."""

import numpy as np

from tidewater.llm import language


def test_copies_and_long_texts_do_not_starve_a_language(spark):
    rows = [("aa", f"copied text {i % 3}") for i in range(6000)] + [("aa", f"text number {i} of its own") for i in range(300)]
    rows += [("bb", "the only text there is")] * 5000 + [("cc", "eine lange Geschichte " * 2000), ("dd", ""), (None, "none")]
    rows += [("ee", f"many different texts {i}") for i in range(3000)]
    sample = language.labelled_sample(spark.createDataFrame(rows, "lang string, text string"), "text", "lang", None)
    of = {own: [t for lang, t in sample if lang == own] for own in {lang for lang, _ in sample}}
    assert {own: len(texts) for own, texts in of.items()} == {"aa": 303, "bb": 1, "cc": 1, "ee": language.PER_LANGUAGE}
    assert len(of["cc"][0]) == language.FIT_CHARS


def test_no_ngram_is_lost():
    """More n-grams than the tables have room for: every one is found, under its own number, and none beside them."""
    rng = np.random.default_rng(5)
    grams = np.unique(rng.integers(0, 1 << 63, 1_500_000, dtype=np.uint64))
    model = language.Model(["x"], grams, np.zeros((len(grams), 1), np.float32))
    assert len(model.grams) == len(grams) and len(model.rest) > 1000
    codes = np.concatenate([grams, rng.integers(1 << 63, (1 << 64) - 1, 1000, dtype=np.uint64)])
    at, found = model.find(codes)
    assert sorted(at.tolist()) == list(range(len(grams))) and (found == at).all()


def test_sample_is_bounded_over_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "ALL_TEXTS", 60)
    rows = [(f"l{i % 20:02d}", f"text number {i}") for i in range(600)]
    sample = language.labelled_sample(spark.createDataFrame(rows, "lang string, text string"), "text", "lang", None)
    assert {lang: sum(own == lang for own, _ in sample) for lang, _ in sample} == {f"l{i:02d}": 3 for i in range(20)}
