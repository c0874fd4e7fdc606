"""Samples that models learn from, where most rows have no id, or one id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from groveframe.llm import attention_model, language_model, languages

from .test_operators import RANKS, words


def hot_docs(spark, n=4000):
    rng = np.random.default_rng(3)
    rows = [(None if i % 10 else 5 if i % 3 else i, " ".join(words(30, int(rng.integers(10**6)))), "en" if i % 4 else "de") for i in range(n)]
    return spark.createDataFrame(rows + [(None, "one text of many rows " * 10, "en")] * n, "doc_id long, text string, lang string")


def test_language_samples_of_rows_without_ids(spark):
    samples = languages.learn_samples(hot_docs(spark))
    assert set(samples) == {"en", "de"}
    assert all(2000 < len(s) <= languages.SAMPLE_CHARS + 200 for s in samples.values())
    assert samples["en"].count("one text of many rows") <= 10


def test_language_model_sample_of_rows_without_ids(spark, monkeypatch):
    drawn = {}
    monkeypatch.setattr(language_model, "TRAIN_SUBWORDS", 20_000)
    real = language_model.Speller.read

    def read(self, texts):
        drawn.setdefault("n", len(texts))
        return real(self, texts)

    docs = hot_docs(spark, 1500)
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    counts = language_model.materialize(language_model.corpus_counts(docs.select("text"), path), "word-counts")
    monkeypatch.setattr(language_model.Speller, "read", read)
    language_model.learn(docs.select("doc_id", "text", F.lit(False).alias("held_out")), counts, path, steps=1)
    assert 20 < drawn["n"] < 400


def test_language_model_sample_grows_with_the_corpus():
    sizes = [language_model.sample_size(10**k) for k in range(3, 15)]
    assert sizes[:4] == [10**3, 10**4, 10**5, 10**6]
    assert all(a < b for a, b in zip(sizes, sizes[1:], strict=False)) and sizes[-1] < 100_000_000


def test_attention_goes_through_every_training_document(spark, monkeypatch):
    """Beyond the sample it starts from, each task's documents move the parameters: the mean over tasks, weighed by windows, of plain passes."""
    monkeypatch.setattr(language_model, "TRAIN_SUBWORDS", 50)
    rows = [(i, " ".join(words(40 + 20 * i, 70 + i))) for i in range(18)]
    training = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(2, "doc_id").sortWithinPartitions("doc_id")
    texts = [[r.text for r in part] for part in training.rdd.glom().collect()]
    assert len(texts) == 2 and all(texts)
    model = language_model.learn(training, language_model.corpus_counts(training.select("text"), RANKS), RANKS, 3)
    start, learned = model.parameters, []
    for part in texts:
        learner = attention_model.Learner(start)
        sequence = model.texts(language_model.speller(RANKS).read(pa.array(part)), len(part))
        n = learner.go_through(sequence, model.prior_without(sequence), seed=0)
        assert n == len(attention_model.windows(sequence.lengths).at)
        learned.append((n, learner.p))
    language_model.go_through(model, training, RANKS)
    for k, got in model.parameters.items():
        expected = sum(n * p[k] for n, p in learned) / sum(n for n, _ in learned)
        # Adam makes steps of gradients that are next to nothing, where the order of sums shows
        assert np.abs(got - expected).mean() <= 0.05 * np.abs(expected - start[k]).mean()
    assert not np.allclose(model.parameters["U"], start["U"], atol=1e-4)


def test_training_pass_takes_no_probabilities_within_groups(spark, monkeypatch):
    """Only scores need them: look-ups of every subword among frequent edges and pairs."""
    docs = spark.createDataFrame([(i, " ".join(words(60, 90 + i))) for i in range(6)], "doc_id long, text string")
    model = language_model.learn(docs, language_model.corpus_counts(docs.select("text"), RANKS), RANKS, 2)
    monkeypatch.setattr(type(model.prior), "place", None)
    known = language_model.speller(RANKS).read(pa.array(["the tree", None, "of trees"]))
    sequence = model.texts(known, 3)
    assert sequence.lengths[1] == 1 and sequence.lengths.sum() == len(sequence.ids)
    assert attention_model.Learner(model.parameters).go_through(sequence, model.prior_without(sequence)) == 3
