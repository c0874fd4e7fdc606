"""Quality scores by a generalised additive model with pairwise interactions.

Each document becomes a row of numbers that describe its characters, words and lines. Shallow trees are boosted in cycles, one
feature at a time, on the logistic loss; since each tree sees one feature, the sum of a feature's trees is a look-up table over
its bins. Then the pairs of features that reduce the remaining loss most get tables of their own in the same way. Scoring is a
sum of look-ups: the intercept, one addition per feature, one per pair.

Learning uses a bounded sample of labelled rows (``TRAIN_ROWS``, drawn by hash from the training folds); features and scores
cover every row and whole texts. Labels, lang, source and doc_id are never inputs.

Defined cases: null texts count as empty, empty texts get a score of their own like any other; without labels of both kinds the
score is the share of label 1 (0.5 if there are none); several labels of one document count as several rows; labels other than
0 and 1 are left out; repeated rows get a result each; null ids have no label; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fraction_of, materialize, table

TRAIN_ROWS, BINS, PAIR_BINS, PAIRS = 20_000, 48, 8, 10
CYCLES, PAIR_CYCLES, RATE, LEAVES, LEAST_ROWS, SHRINK = 120, 60, 0.15, 4, 20, 5.0

FEATURES = [
    "chars", "words", "word_length", "upper", "lower", "digit", "space", "other_ascii", "beyond_ascii", "bang", "hash_dollar", "bar",
    "stop", "comma", "colon", "angle", "distinct_words", "repeats", "distinct_pairs", "top_word", "short_words", "long_words",
    "title_words", "lines", "line_words", "distinct_lines", "line_end", "entropy", "word_punct",
]


def class_table() -> np.ndarray:
    """Byte -> class of the character counts: upper, lower, digit, space, other, beyond ASCII, then single marks."""
    out = np.full(256, 4, np.uint8)
    out[65:91], out[97:123], out[48:58], out[128:] = 0, 1, 2, 5
    for i, marks in enumerate(("!", "#$%&*", "|", ".", ",", ":;", "<>{}=")):
        for c in marks.encode():
            out[c] = 6 + i
    for c in b" \t\n\r\x0b\x0c":
        out[c] = 3
    return out


CLASSES = class_table()


def describe(text: str) -> list[float]:
    """The features of one text, in the order of FEATURES."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    size = max(1, len(data))
    counts = np.bincount(data, minlength=256)
    kinds = np.bincount(CLASSES, counts, 13) / size
    shares = counts[counts > 0] / size
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    follow = list(zip(words, words[1:], strict=False))
    return [
        np.log1p(len(text)), np.log1p(len(words)), float(lengths.mean()) if len(words) else 0.0, *kinds[[0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]],
        len(seen) / n, sum(a == b for a, b in follow) / n, len(set(follow)) / n, max(seen.values(), default=0) / n, float((lengths <= 3).mean()) if len(words) else 0.0,
        float((lengths > 12).mean()) if len(words) else 0.0, sum(map(str.istitle, words)) / n, np.log1p(len(lines)), np.log1p(n / m), len(set(lines)) / m,
        sum(x.rstrip()[-1:] in ".!?" for x in lines) / m, float(-(shares * np.log2(shares)).sum()), sum(not w[-1].isalnum() for w in words) / n,
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x (array of features) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                flat = np.array([describe(t or "") for t in part.column(1).to_pylist()], np.float32).ravel()
                offsets = np.arange(part.num_rows + 1, dtype=np.int32) * len(FEATURES)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "x"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, x array<float>")


def best_steps(grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """A shallow tree over ordered bins by repeated best splits: its Newton step for each bin."""
    cg, ch, cn = (np.concatenate([[0.0], np.cumsum(x)]) for x in (grad, hess, rows))
    parts = [(0, len(grad))]

    def value(i, j):
        return (cg[j] - cg[i]) ** 2 / (ch[j] - ch[i] + SHRINK)

    while len(parts) < leaves:
        found = (1e-9, 0, 0)
        for k, (i, j) in enumerate(parts):
            cuts = np.arange(i + 1, j)
            cuts = cuts[(cn[cuts] - cn[i] >= LEAST_ROWS) & (cn[j] - cn[cuts] >= LEAST_ROWS)]
            if len(cuts):
                gain = value(i, cuts) + value(cuts, j) - value(i, j)
                b = int(gain.argmax())
                found = max(found, (float(gain[b]), k, int(cuts[b])))
        if not found[2]:
            break
        i, j = parts.pop(found[1])
        parts += [(i, found[2]), (found[2], j)]
    out = np.zeros(len(grad))
    for i, j in parts:
        out[i:j] = (cg[j] - cg[i]) / (ch[j] - ch[i] + SHRINK)
    return out


def best_quadrants(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """The best pair of cuts of a two-feature grid: its gain over the whole and the step of each cell."""
    sums = [np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (grad, hess)]

    def quadrants(s):
        a, r, c, t = s[1:-1, 1:-1], s[1:-1, -1:], s[-1:, 1:-1], s[-1, -1]
        return np.stack([a, r - a, c - a, t - r - c + a])

    g, h = quadrants(sums[0]), quadrants(sums[1]) + SHRINK
    gain = (g**2 / h).sum(0) - sums[0][-1, -1] ** 2 / (sums[1][-1, -1] + SHRINK)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out, step = np.empty(grad.shape), (g / h)[:, i, j]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = step
    return float(gain[i, j]), out


@dataclass
class AdditiveModel:
    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, by bin look-ups and additions."""
        total = np.full(len(x), self.intercept)
        for f, steps in enumerate(self.tables):
            total += steps[np.searchsorted(self.cuts[f], x[:, f], "right")]
        for a, b, steps in self.pairs:
            total += steps[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of single features, then of the strongest pairs on what remains."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return AdditiveModel(float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    share = y.mean()
    model = AdditiveModel(float(np.log(share / (1 - share))))
    width = x.shape[1]
    model.cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(width)]
    model.coarse = [np.unique(np.quantile(x[:, f], np.arange(1, PAIR_BINS) / PAIR_BINS)) for f in range(width)]
    bins = [np.searchsorted(model.cuts[f], x[:, f], "right") for f in range(width)]
    rough = [np.searchsorted(model.coarse[f], x[:, f], "right") for f in range(width)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    rows = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables, strict=True)]
    total = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(CYCLES):
        for f in range(width):
            g, h = slopes()
            n = len(model.tables[f])
            step = RATE * best_steps(np.bincount(bins[f], g, n), np.bincount(bins[f], h, n), rows[f])
            model.tables[f] += step
            total += step[bins[f]]

    def grid(a, b, v):
        na, nb = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        return np.bincount(rough[a] * nb + rough[b], v, na * nb).reshape(na, nb)

    g, h = slopes()
    gains = [(best_quadrants(grid(a, b, g), grid(a, b, h))[0], a, b) for a in range(width) for b in range(a) if len(model.coarse[a]) and len(model.coarse[b])]
    chosen = [(a, b, np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1))) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(PAIR_CYCLES):
        for a, b, steps in chosen:
            g, h = slopes()
            step = RATE * best_quadrants(grid(a, b, g), grid(a, b, h))[1]
            steps += step
            total += step[rough[a], rough[b]]
    model.pairs = chosen
    return model


def learn(described: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> AdditiveModel:
    """Fits on at most about TRAIN_ROWS labelled rows outside the held-out fold."""
    rows = labels.where("quality in (0, 1) and doc_id is not null").where(fraction_of(F.col("doc_id"), folds) != held_out).select("doc_id", "quality")
    n = rows.count()
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, TRAIN_ROWS / max(1, n)) * (1 << 30)))
    got = described.join(drawn, "doc_id").orderBy("doc_id", "quality").limit(2 * TRAIN_ROWS).toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array(got.column("quality").to_pylist(), np.float64))


def score(described: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, score of every described row."""
    sent = described.sparkSession.sparkContext.broadcast(model)  # bounded by features and bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(x))], ["doc_id", "score"])

    return described.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = materialize(features(table(spark, sf_dir, "documents")), "quality-features")
    scored = score(described, learn(described, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fraction_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
