"""Shingle join on short texts, whose sets may leave most blocks of a sketch empty."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from groveframe.llm import common, shingle_join, subwords

from .test_operators import brute_components, joined


def in_one_block(text: str) -> bool:
    found = shingle_join.shingle_sets([text])[0]
    band = shingle_join.bands_of(len(found))[-1]
    blocks = shingle_join.BLOCKS[band][1]
    return len(np.unique(((found >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32))) == 1


def eight_words(wanted: bool) -> str:
    return next(t for t in (" ".join(f"w{i}x{k}" for i in range(8)) for k in range(5000)) if in_one_block(t) == wanted)


@pytest.mark.parametrize(("n", "one_block"), [(45, True), (60, False)])
def test_one_short_text_and_its_extensions(spark, n, one_block):
    short = eight_words(one_block)
    texts = [short] + [f"{short} ninth{k}" for k in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r[3] for r in joined(docs)} == {0}


def test_families_of_short_texts(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "SHARE", 3)
    rng = random.Random(4)
    texts = []
    for k in range(12):
        short = eight_words(True) if k == 0 else " ".join(f"f{k}w{i}" for i in range(rng.randint(5, 14)))
        texts += [short + " " + " ".join(f"e{rng.randint(0, 40)}" for _ in range(rng.randint(0, 2))) for _ in range(40)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert joined(docs) == sorted(brute_components(docs.collect()), key=str)


def test_each_class_leaves_out_its_most_frequent_words(spark):
    """Near copies with more common words than they have to spare leave out some of them, and any two that link still share a kept one."""
    rng, base = random.Random(6), [f"b{i}" for i in range(70)]
    texts = [" ".join(w if rng.random() < 0.97 else f"e{k}x{i}" for i, w in enumerate(base)) for k in range(40)]
    sets, names = shingle_join.shingle_sets(texts), shingle_join.ClassNames()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    live = shingle_join.key_rows(docs, names).distinct()
    live = live.join(live.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key").withColumn("root", F.col("c"))
    kept, before = {}, {}
    for out, rows in ((before, live), (kept, shingle_join.kept_words(live, shingle_join.summaries(docs, names)))):
        for r in rows.collect():
            out.setdefault(r.c, set()).add(r.key)
    assert sum(map(len, kept.values())) < sum(map(len, before.values()))
    of, linked = [names(s)[0] for s in sets], 0
    for i, j in combinations(range(len(texts)), 2):
        if of[i] != of[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])):
            linked += 1
            assert kept[of[i]] & kept[of[j]]
    assert linked > 20


def test_workers_keep_only_the_tables_of_their_work():
    """A token stage leaves its words in a reused worker; the next stage's tasks empty them, and the other way round."""
    import public_tokenizers

    encoder = subwords.encoder_of(public_tokenizers.path("byte_bpe_50k.json"), 2)
    encoder.encode(["some words of a text"])
    shingle_join.shingle_sets(["some words of a text"])
    common.use_only("words")
    assert shingle_join._WORDS and not subwords._ENCODERS
    subwords.encoder_of(public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert subwords._ENCODERS and not shingle_join._WORDS
