"""Benchmark decontamination: n-gram seeds find passages of test items, word-level Smith-Waterman scores them.

Seeds are the word trigrams of the items, common ones too, so what is found in a document does not depend on how many others hold
the same passage. One pass looks up the seeds in every document, joins neighbouring hits of an item into windows, and aligns
window and item: match 2, mismatch -1, gap -1, the score divided by that of the whole item. Only the parts of a window are
aligned in which enough words of the item lie close enough together for the threshold; the bound is exact.

The test items are the stated query set. They are taken in blocks of at most ``BLOCK_WORDS`` words, each sent to all tasks; any
number of blocks follows, so a benchmark of any size works. No document leaves its task: nothing is shuffled.

Defined cases: words are runs of letters and digits, in lower case; null texts count as empty; items without words match
nothing; items of under ``SHORT`` words need a score of ``SHORT_SCORE``; equal items and repeated rows are all reported; null
ids pass through; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .shingle_join import mix

N, THRESHOLD, SHORT, SHORT_SCORE, BLOCK_WORDS = 3, 0.5, 8, 0.9, 200_000
MATCH, MISMATCH, GAP = 2, -1, 1
WORD = re.compile(r"[^\W_]+")
SCHEMA = "doc_id long, item_id long, score double, start_word int, end_word int"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: score divided by that of the whole item, first and last+1 word of the window."""
    steps = GAP * np.arange(len(window) + 1)
    row, start = np.zeros(len(window) + 1), np.arange(len(window) + 1)
    best = (0.0, 0, 0)
    for word in item:
        diagonal = row[:-1] + np.where(window == word, MATCH, MISMATCH)
        new = np.zeros_like(row)
        origin = np.arange(len(window) + 1)
        for value, source in ((diagonal, start[:-1]), (row[1:] - GAP, start[1:])):
            better = value > new[1:]
            new[1:][better], origin[1:][better] = value[better], source[better]
        lifted = new + steps
        top = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted == top, np.arange(len(lifted)), 0))
        row, start = top - steps, origin[at]
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (float(row[k]), int(start[k]), k)
    return best[0] / (MATCH * max(1, len(item))), best[1], best[2]


def span_of(size: int, need: float) -> int:
    """The most words of a document that an alignment of a score of ``need`` covers: each gap costs half a match."""
    return max(2 * size, math.ceil(size + 2 * size * (1 - need)))


def dense(own: np.ndarray, span: int, least: float) -> list[tuple[int, int]]:
    """Bounds of the parts in which ``span`` words in a row hold at least ``least`` words of the item; overlapping ones are one."""
    total = np.concatenate([[0], np.cumsum(own)])
    span = min(span, len(own))
    starts = np.flatnonzero(total[span:] - total[: len(total) - span] >= least)
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > span)
    return list(zip(starts[np.concatenate([[0], cuts + 1])].tolist(), (starts[np.concatenate([cuts, [-1]])] + span).tolist(), strict=True))


class ItemBlock:
    """Vocabulary and seeds of a block of items: [(item_id, words)]."""

    def __init__(self, items: list[tuple[int | None, list[str]]]):
        self.items = items
        self.vocabulary = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for _, words in items for w in words))}
        self.base = len(self.vocabulary) + 1
        self.coded = [np.array([self.vocabulary[w] for w in words], np.int64) for _, words in items]
        self.sizes = sorted({min(N, len(c)) for c in self.coded if len(c)})
        places = defaultdict(set)
        for k, c in enumerate(self.coded):
            for code in self.grams(c, min(N, len(c))) if len(c) else []:
                places[int(code)].add(k)
        self.seeds = np.array(sorted(places), np.int64)
        owners = [sorted(places[int(s)]) for s in self.seeds]
        self.first = np.cumsum([0, *map(len, owners)])
        self.owner = np.array([k for o in owners for k in o], np.int64)

    def encode(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def grams(self, coded: np.ndarray, n: int) -> np.ndarray:
        """A number for each run of n known words, -1 for others; with vocabularies of over two million words a hash of the run."""
        count = max(0, len(coded) - n + 1)
        out, known = np.full(count, n, np.uint64), np.ones(count, bool)
        for i in range(n):
            part = coded[i : i + count]
            out = mix(out + part.astype(np.uint64)) if self.base >= 1 << 21 else out * np.uint64(self.base) + part.astype(np.uint64)
            known &= part > 0
        return np.where(known, (out >> np.uint64(1) if self.base >= 1 << 21 else out).astype(np.int64), -1)

    def hits(self, coded: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and seed numbers of the seeds in a document."""
        at, which = [], []
        for n in self.sizes:
            codes = self.grams(coded, n)
            live = np.flatnonzero(codes >= 0)
            found = np.minimum(np.searchsorted(seeds, codes[live]), max(0, len(seeds) - 1))
            same = seeds[found] == codes[live] if len(seeds) else np.zeros(len(live), bool)
            at.append(live[same])
            which.append(found[same])
        return (np.concatenate(at), np.concatenate(which)) if at else (np.zeros(0, int), np.zeros(0, int))

    def places(self, coded: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each item with seeds in a document and the positions of those, in order."""
        at, which = self.hits(coded, self.seeds)
        counts = self.first[which + 1] - self.first[which]
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        item, pos = self.owner[np.repeat(self.first[which], counts) + inner], np.repeat(at, counts)
        order = np.lexsort((pos, item))
        item, pos = item[order], pos[order]
        cuts = np.flatnonzero(np.diff(item)) + 1
        return zip(item[np.concatenate([[0], cuts])].tolist() if len(item) else [], np.split(pos, cuts), strict=False)

    def matches(self, text: str | None, threshold: float) -> list[tuple[int | None, float, int, int]]:
        coded = self.encode(text)
        known, own = np.zeros(self.base, bool), np.zeros(self.base, bool)
        known[coded] = True
        out = []
        for k, found in self.places(coded):
            item, best = self.coded[k], (0.0, 0, 0)
            size, need = len(item), threshold if len(item) >= SHORT else max(threshold, SHORT_SCORE)
            least, span = need * size - 1e-9, span_of(size, need)
            if known[item].sum() < least:
                continue
            own[item] = True
            for hits in np.split(found, np.flatnonzero(np.diff(found) > 2 * size) + 1):
                low, high = max(0, int(hits[0]) - span), min(len(coded), int(hits[-1]) + span)
                for a, b in dense(own[coded[low:high]], span, least):
                    window = coded[low + a : low + b]
                    if np.isin(item, window).sum() >= least:
                        score, start, end = align(item, window)
                        best = max(best, (score, low + a + start, low + a + end), key=lambda x: x[0])
            own[item] = False
            if best[0] >= need:
                out.append((self.items[k][0], *best))
        return out


def blocks_of(items: DataFrame, id_col: str, text_col: str) -> Iterator[ItemBlock]:
    held, words = [], 0
    for r in items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).orderBy("id", "text").toLocalIterator():
        held.append((r["id"], words_of(r["text"])))
        words += len(held[-1][1])
        if words >= BLOCK_WORDS:
            yield ItemBlock(held)
            held, words = [], 0
    if words:
        yield ItemBlock(held)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word) of every document passage that aligns with an item."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spark, out = docs.sparkSession, None
    for block in blocks_of(items, item_id, item_text):
        sent = spark.sparkContext.broadcast(block)  # at most BLOCK_WORDS words and one item

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(key, *m) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in sent.value.matches(text, threshold)]
                cols = list(zip(*found, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "score", "start_word", "end_word"])

        got = materialize(rows.mapInArrow(find, SCHEMA), "contaminated")
        out = got if out is None else out.unionByName(got)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no passage of an item. A row is decided by its own text where it is read, so rows need no key,
    are not written and not joined; only what a block of items leaves is written for the next one."""
    spark, out, column = docs.sparkSession, docs, docs.columns.index(text_col)
    for i, block in enumerate(blocks_of(items, item_id, item_text)):
        sent = spark.sparkContext.broadcast(block)  # at most BLOCK_WORDS words and one item

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not sent.value.matches(text, threshold) for text in batch.column(column).to_pylist()], pa.bool_()))

        out = (materialize(out, "clean-rows") if i else out).mapInArrow(keep, docs.schema)
    return out


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
