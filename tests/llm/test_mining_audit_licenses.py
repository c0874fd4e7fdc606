"""Hard negatives, divergence audit and license scan against brute force, and on odd rows."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from groveframe.llm import divergence, licenses, negatives

VECTORS = "vec_id long, embedding array<float>, label int, score string, d string, extra int"


def mined_rows(spark, rows, rules=negatives.Rules()):
    df = negatives.usable(spark.createDataFrame(rows, VECTORS), "embedding", "label")
    whole = F.transform("embedding", lambda x: negatives.scaled(x.cast("double") * 256.0))
    out = negatives.mine(df.select("vec_id", "label", whole.alias("v"), "score", "d"), F.col("vec_id") % 50 == 0, rules)
    return sorted(map(tuple, out.collect()), key=repr)


def brute_negatives(rows, rules=negatives.Rules()):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label, *_ in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v, label) in enumerate(good):
        if i is None or i % 50:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for k, (j, w, other) in enumerate(good) if k != at]  # noqa: B905 (zeros beyond the shorter)
        scored.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        for score, j, _ in [r for r in scored if r[2] == label][: rules.positives]:
            fit = [r for r in scored if r[2] != label and rules.low * score <= 100 * r[0] <= rules.high * score][: rules.negatives]
            out += [(i, j, rank + 1, n[1], score, n[0]) for rank, n in enumerate(fit)]
    return sorted(out, key=repr)


def vectors(n, seed=3, labels=4, width=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, width))
    return [(i, (centres[i % labels] * 0.3 + rng.normal(size=width)).astype(np.float32).tolist(), int(rng.integers(labels)), "x", "y", 1) for i in range(n)]


def test_negatives_brute_force(spark, monkeypatch):
    rows = vectors(900)
    assert mined_rows(spark, rows) == brute_negatives(rows)
    # small blocks of anchors and rows, few pivots, always the sparse way
    for name, value in (("ANCHORS", 4), ("BATCH", 7), ("PIVOTS", 3), ("SAMPLE", 20), ("DENSE", 2.0)):
        monkeypatch.setattr(negatives, name, value)
    assert mined_rows(spark, rows[:500], negatives.Rules(3, 4, 20, 90)) == brute_negatives(rows[:500], negatives.Rules(3, 4, 20, 90))


def test_negatives_of_a_hot_vector_and_ties(spark):
    rows = vectors(300)
    # a third of all rows is one vector, with many labels and ids, and whole rows are repeated
    rows += [(1000 + i, rows[0][1], i % 3, "x", "y", 1) for i in range(150)] + [(50, rows[50][1], rows[50][2], "x", "y", 1)] * 9
    assert mined_rows(spark, rows) == brute_negatives(rows)


def test_negatives_of_odd_rows(spark):
    v = [1.0, 2.0]
    rows = [
        (0, v, 1, None, None, 0), (50, None, 1, None, None, 0), (100, [1.0, None], 1, None, None, 0), (150, [float("nan"), 1.0], 2, None, None, 0), (200, v, None, None, None, 0),
        (None, v, 1, None, None, 0), (None, [0.9, 1.5], 2, None, None, 0), (250, [1.0], 2, None, None, 0), (300, [], 2, None, None, 0), (350, [1.0, 1.0, 5.0], 1, None, None, 0), (3, [0.5, 0.9], 2, None, None, 0),
    ]
    got = mined_rows(spark, rows)
    assert got == brute_negatives(rows) and any(r[1] is None for r in got) and any(r[3] is None for r in got)
    assert mined_rows(spark, []) == []
    assert mined_rows(spark, [(7, v, 1, None, None, 0)]) == []
    with pytest.raises(ValueError, match="beyond"):
        mined_rows(spark, [(0, [1e30], 1, None, None, 0), (1, [1e30], 1, None, None, 0)])


def test_large_scores_are_exact():
    a, b = np.array([[2.0**30, 3.0]]), np.array([[2.0**30, 1.0]])
    assert negatives.products(a, b, 2.0**61)[0, 0] == negatives.pair_products(a, b, 2.0**61)[0] == 2**60 + 3
    with pytest.raises(ValueError, match="64 bits"):
        negatives.products(a, b, 2.0**63)


def test_bounds_hold_the_scores():
    rng = np.random.default_rng(0)
    rows, asked = np.floor(rng.normal(size=(300, 8)) * 40), np.floor(rng.normal(size=(20, 8)) * 60)
    largest = (rows**2).sum(1).max()
    pivots = negatives.far_apart(negatives.augmented(rows, largest), 5)
    d = negatives.distances(negatives.augmented(rows, largest), pivots)
    block = {"d": negatives.distances(np.column_stack([asked, np.zeros(20)]), pivots), "norm": (asked**2).sum(1)}
    high, low = negatives.upper(block, d.T, d.T, largest)
    scores = asked @ rows.T
    assert (low <= scores).all() and (scores <= high).all() and (high - low).mean() < 2 * np.sqrt(largest * block["norm"].max())
    high, low = negatives.upper(block, d.T.min(1, keepdims=True), d.T.max(1, keepdims=True), largest)
    assert (low <= scores).all() and (scores <= high).all()


DOCS = "doc_id long, text string, lang string, source string, term string, n int"


def audited(spark, rows, threshold=30, most=50):
    return sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, DOCS), threshold, most).collect()))


def brute_audit(rows, threshold=30, most=50):
    found, groups = defaultdict(list), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found[lang, source].append(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered))
    out = []
    for lang, sources in groups.items():
        df = Counter(t for s in sources for words in found[lang, s] for t in set(words))
        kept = sorted(t for t in df if df[t] >= threshold)
        counts = {s: Counter(w for words in found[lang, s] for w in words if df[w] >= threshold) for s in sources}
        total = sum(counts.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))  # noqa: B023

        p = {s: {t: share(counts[s], t) for t in kept} for s in sources}
        q = {t: share(total, t) for t in kept}
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(terms[:most])]
    return sorted(out)


def made_docs(n=400, seed=5):
    rng = np.random.default_rng(seed)
    vocabulary = [f"Wort{chr(97 + i)}é" if i % 3 else f"term{chr(97 + i)}" for i in range(26)] + ["ÀB", "日本", "a"]
    weights = rng.random((6, len(vocabulary))) ** 3
    out = []
    for i in range(n):
        s = int(rng.integers(6)) if i % 3 else 0
        w = weights[s] / weights[s].sum()
        out.append((i, " 1.".join(rng.choice(vocabulary, int(rng.integers(0, 60)), p=w)), ["en", "de", None][i % 3], None if s == 5 else f"src{s}", "x", 1))
    return out


def test_audit_brute_force(spark, monkeypatch):
    rows = made_docs()
    assert audited(spark, rows) == brute_audit(rows)
    assert audited(spark, rows, 3, 2) == brute_audit(rows, 3, 2)
    # a sketch that is full, and tables that are handed on early, change nothing
    for name, value in (("WIDTH", 16), ("BLOCK", 8), ("DEPTH", 2), ("HELD", 3)):
        monkeypatch.setattr(divergence, name, value)
    assert audited(spark, rows) == brute_audit(rows)


def test_sketch_never_underestimates_and_drops_what_is_rare(spark):
    rows = made_docs() + [(9, f"rare{chr(97 + i % 26)}{chr(97 + i // 26)}", "en", "src0", "x", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS).select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = {(r["lang"], r["term"]) for r in divergence.survivor_counts(docs, 30).collect()}
    df = Counter((lang or "", t) for _, text, lang, *_ in rows for t in {w.decode() for w in divergence.terms_of(text.encode())})
    assert {k for k, n in df.items() if n >= 30} <= kept and not any(t.startswith("rare") for _, t in kept)


def test_audit_of_odd_rows(spark):
    assert audited(spark, []) == []
    rows = [(None, None, None, None, None, None), (1, "", "", "", None, None), (1, "123 !?", "en", "a", None, None), (2, "x " * 50000, "en", "b", None, None), (2, "x " * 50000, "en", "b", None, None)]
    assert audited(spark, rows) == brute_audit(rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert audited(spark, rows, 1) == brute_audit(rows, 1)


def test_shares_beyond_64_bits(spark):
    row = spark.sql("select 5000000000000L as c, 9000000000000L as n, 7L as v")
    assert divergence.exact_share(row, "p", "c", "n", "v").first()["p"] == 1 + 10**9 * (5 * 10**12 + 5) // (9 * 10**12 + 35)


def scanned(spark, texts, **more):
    return {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **more).collect()}


def as_regex(sequence):
    out = ""
    for kind, *what in sequence:
        out += {"word": lambda: re.escape(what[0]) + " ", "any": lambda: r"(?:\S+ ){%d,%d}" % tuple(what), "optional": lambda: f"(?:{as_regex(what[0])})?", "choice": lambda: "(?:" + "|".join(map(as_regex, what[0])) + ")"}[kind]()  # noqa: B023
    return out


def filled(sequence, rng):
    """A text that a template accepts."""
    out = []
    for kind, *what in sequence:
        if kind == "word":
            out.append(what[0])
        elif kind == "any":
            out += [f"name{k}" for k in range(int(rng.integers(what[0], what[1] + 1)))]
        elif kind == "choice":
            out += filled(what[0][int(rng.integers(len(what[0])))], rng)
        elif rng.random() < 0.5:
            out += filled(what[0], rng)
    return out


def test_templates_accept_their_texts_and_no_others(spark):
    rng = np.random.default_rng(1)
    texts = []
    for label, markup in licenses.TEMPLATES:
        for k in range(6):
            words = filled(licenses.parsed(markup), rng)
            if k >= 3:  # one word changed, dropped or added anywhere
                i = int(rng.integers(len(words)))
                words[i : i + 1] = [["altered"], [], [words[i], "added"]][k - 3]
            texts.append("/* Begin, " + ".\n * ".join(w.upper() if rng.random() < 0.3 else w for w in words) + "; end */ 42")
        assert label in scanned(spark, [texts[-6]])[0]["labels"].split(",")
    got = scanned(spark, texts)
    for i, text in enumerate(texts):
        line = " " + "".join(w.decode() + " " for w in licenses.words_of(text.encode()))
        want = {label for label, markup in licenses.TEMPLATES if re.search(" " + as_regex(licenses.parsed(markup)), line)}
        want |= {label for phrase, label in licenses.PHRASES.items() if f" {phrase} " in line}
        assert got[i]["labels"] == ",".join(sorted(want))
        assert 0 <= got[i]["score"] < 1 and (got[i]["score"] > 0) == bool(want)


def test_regions_are_spans_of_words(spark):
    got = scanned(spark, ["It is licensed under the Apache License, Version 2.0 (the License); and so on."])[0]
    assert [(r["label"], r["first"], r["last"]) for r in got["regions"]] == [("apache-2", 2, 11)]
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == (15, 1, 5, 5, "apache-2")


def test_base_places_overlap_and_repeat(spark):
    got = scanned(spark, ["CC-BY-NC cc by nc cc by ncx", "a a a a", "Under the MIT license under The mit-license"], phrases={**licenses.PHRASES, "a a": "aa"})
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"]) == (2, 0, 3)
    assert (got[1]["n_base"], got[1]["last_word"], got[1]["labels"]) == (3, 2, "aa")
    assert (got[2]["n_base"], got[2]["base_labels"]) == (2, "mit")


def test_scan_of_odd_rows(spark):
    rows = [(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "\x00 !!", "x"), (3, "wörd 日本 under the mit license " + "copyright " * 30000, "x")]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_base"], r["labels"], r["score"]) for r in out) == [(0, 0, 0, "", 0.0), (1, 0, 0, "", 0.0), (1, 0, 0, "", 0.0), (2, 0, 0, "", 0.0), (3, 30006, 1, "mit", 4 / 12)]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_markup_is_checked():
    with pytest.raises(ValueError, match="closed"):
        licenses.parsed("a [b")
    for markup in ("[a]", "{0..3} a"):
        with pytest.raises(ValueError, match="begins"):
            licenses.Automaton.of("x", markup)
