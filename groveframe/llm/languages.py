"""Language identification by cross-parsing: the language whose sample text explains a document in the fewest phrases wins.

For each language a suffix automaton of a labelled sample answers how far the current phrase of a document can be extended and
still occur in the sample. A document is parsed greedily into longest such phrases; the number of phrases c, normalised as
c * log2(sample length) / symbols, estimates its cross entropy against that language. The lowest wins, ties go to the first
language by name.

Texts are parsed whole, as folded letters with runs of other characters as one blank. To step many at once they are cut into
lanes of ``LANE`` symbols, each parsed as if it began a phrase; then each lane is parsed again from the state in which the lane
before it ended, until it meets the states found first, and so on while ends change. The result is that of one parse from start
to end. The automata are dense tables, so a step is a table look-up for all lanes.

The labelled sample is bounded by rows: whole documents of the training folds in the order of a hash, of at most
``SAMPLE_CHARS`` characters a language together (if all are longer, the shortest one, whole). Everything else covers all rows.

Defined cases: ``und`` with score 0 for null texts, texts without a letter, or if nothing was learned; null ids pass through;
repeated rows get a result each; an empty table gives an empty result; further columns are ignored unless asked for.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fraction_of, table, use_only

SAMPLE_CHARS, SAMPLE_DOCS, MAX_LANGUAGES = 20_000, 60, 512
#: Letters with a symbol of their own, and symbols that all further letters share by code point.
LETTERS, SHARED = 120, 120
LANE, STEP_CHARS = 512, 1 << 20


class Alphabet:
    """Code points to symbols: 0 for what is no letter, then the folded letters of the samples, the last for letters they lack."""

    def __init__(self, samples: list[str]):
        seen = Counter(c for s in samples for c in s.lower() if c.isalpha())
        ranked = sorted(seen, key=lambda c: (-seen[c], c))
        self.symbols = {c: i + 1 for i, c in enumerate(ranked[:LETTERS])}
        shared = sorted({ord(c) % SHARED for c in ranked[LETTERS:]})
        self.shared = {k: len(self.symbols) + 1 + i for i, k in enumerate(shared)}
        self.size = len(self.symbols) + len(shared) + 2
        self.codes = np.fromiter((self.symbol(chr(c)) for c in range(0x10000)), np.uint8, 0x10000)

    def symbol(self, c: str) -> int:
        if not c.isalpha():
            return 0
        folded = c.lower()[:1]
        return self.symbols.get(folded) or self.shared.get(ord(folded) % SHARED, self.size - 1)

    def encode(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        far = points >= 0x10000
        out = self.codes[np.where(far, 0, points)]
        if far.any():
            out[far] = [self.symbol(chr(c)) for c in points[far]]
        same = np.zeros(len(out), bool)
        same[1:] = (out[1:] == 0) & (out[:-1] == 0)
        return out[~same]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence, built online; state 0 is the root."""
    to: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return to


def parse_table(to: list[dict[int, int]], size: int) -> np.ndarray:
    """Flat look-up table: entry state * width + symbol holds 2 * (next state * width) + 1 if a new phrase starts there.

    Where no transition exists the phrase ends, and the symbol starts the next one. A symbol the sample lacks is a phrase of its
    own: it leads to an extra state from which any symbol starts a phrase. The symbol ``size`` is padding and changes nothing.
    """
    width, n = size + 1, len(to)
    fresh = np.array([2 * width * to[0].get(c, n) + 1 for c in range(size)], np.int64)
    out = np.empty((n + 1, width), np.int64)
    out[:, :size] = fresh
    out[:, size] = 2 * width * np.arange(n + 1)
    for state, edges in enumerate(to):
        for c, target in edges.items():
            out[state, c] = 2 * width * target
    return out.ravel().astype(np.int32 if 2 * width * (n + 1) < 2**31 else np.int64)


class CrossParser:
    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        self.alphabet = Alphabet([samples[k] for k in self.names])
        coded = [self.alphabet.encode(samples[k]) for k in self.names]
        self.bits = np.array([math.log2(max(2, len(s))) for s in coded])
        self.tables = [parse_table(suffix_automaton(s.tolist()), self.alphabet.size) for s in coded]

    def phrases(self, lanes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Phrases that start in each lane, for each language; ``lanes`` is (steps, lanes) of symbols, padded at the end.

        ``begins`` marks the lanes that begin a text; any other goes on with the text of the lane before it.
        """
        out = np.empty((len(self.tables), lanes.shape[1]), np.int64)
        states, starts = np.empty(lanes.shape, np.int32), np.empty(lanes.shape, np.uint8)
        for k, steps in enumerate(self.tables):
            fresh = len(steps) - self.alphabet.size - 1  # the extra state: a phrase starts
            at = np.full(lanes.shape[1], fresh, steps.dtype)
            for i, row in enumerate(lanes):
                got = steps.take(at + row)
                starts[i], at = got & 1, got >> 1
                states[i] = at
            entered = np.full(lanes.shape[1], fresh, np.int32)
            while True:
                due = np.where(begins, fresh, np.roll(states[-1], 1))
                live = np.flatnonzero(due != entered)
                if not len(live):
                    break
                entered, at = due, due[live].astype(steps.dtype)
                for i in range(len(lanes)):
                    got = steps.take(at + lanes[i, live])
                    at = got >> 1
                    starts[i, live] = got & 1
                    apart = states[i, live] != at
                    states[i, live] = at
                    live, at = live[apart], at[apart]
                    if not len(live):
                        break
            out[k] = starts.sum(0, dtype=np.int64)
        return out

    def lanes_of(self, text: str) -> tuple[np.ndarray, int, int]:
        """The lanes of a text (lanes x steps), its number of letters and of symbols."""
        parts, blank = [], False
        for at in range(0, len(text), STEP_CHARS):
            coded = self.alphabet.encode(text[at : at + STEP_CHARS])
            parts.append(coded[1:] if blank and coded[0] == 0 else coded)
            blank = bool(coded[-1] == 0)
        coded = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        n = -(-len(coded) // LANE)
        padded = np.full(n * LANE, self.alphabet.size, np.uint8)
        padded[: len(coded)] = coded
        return padded.reshape(n, LANE), int(np.count_nonzero(coded)), len(coded)

    def rate(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised phrases (languages x texts) and the number of letters of each text."""
        rows, letters, symbols = zip(*map(self.lanes_of, texts), strict=True) if texts else ((), (), ())
        owner = np.repeat(np.arange(len(texts)), [len(r) for r in rows])
        total = np.zeros((len(self.names), len(texts)))
        if len(owner):
            lanes = np.ascontiguousarray(np.concatenate(rows).T).astype(np.int32)
            for k, counts in enumerate(self.phrases(lanes, np.append(True, owner[1:] != owner[:-1]))):
                total[k] = np.bincount(owner, counts, len(texts))
        return total * self.bits[:, None] / np.maximum(symbols, 1), np.array(letters, np.int64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        rate, letters = self.rate([t or "" for t in texts])
        if not len(self.names):
            return ["und"] * len(texts), np.zeros(len(texts))
        best = rate.argmin(0)
        weight = np.exp2(8 * (rate.min(0) - rate)).sum(0)  # of all languages, that of the best being 1
        return [self.names[b] if n else "und" for b, n in zip(best, letters, strict=True)], np.where(letters > 0, 1 / weight, 0.0)




def learn_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, held_out: int = 0) -> dict[str, str]:
    """The bounded sample text of each language, from rows outside the held-out fold."""
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & (fraction_of(F.col("id"), folds) != held_out))
    counts = usable.where("text is not null").groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    # of the text too: rows without an id, or of one id, are drawn as others are
    order = F.pmod(F.xxhash64("id", "lang", "text"), F.lit(1 << 30))
    chosen = F.lit(False)
    for r in counts:
        share = int(min(1.0, SAMPLE_DOCS / r["count"]) * (1 << 30))
        chosen = chosen | ((F.col("lang") == r["lang"]) & (order < share))
    rows = usable.where("text is not null").withColumn("size", F.length("text"))
    drawn = rows.where(chosen & (F.col("size") <= SAMPLE_CHARS)).select("lang", order.alias("o"), "text").distinct().collect()
    held: dict[str, list[str]] = {}
    for r in sorted(drawn, key=lambda r: (r["lang"], r["o"], r["text"])):
        texts = held.setdefault(r["lang"], [])
        if any(c.isalpha() for c in r["text"]) and len(r["text"]) + sum(map(len, texts)) <= SAMPLE_CHARS:
            texts.append(r["text"])
    if missing := [r["lang"] for r in counts if not held.get(r["lang"])]:
        lettered = rows.where(F.col("lang").isin(missing) & F.col("text").rlike("\\p{L}"))
        for r in lettered.groupBy("lang").agg(F.min_by("text", F.struct("size", "text")).alias("text")).collect():
            held[r["lang"]] = [r["text"]]
    return {lang: " ".join(texts) + " " for lang, texts in held.items() if texts}


def identify(docs: DataFrame, samples: dict[str, str], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of all rows, with lang_pred and score."""
    keep = keep or [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = keep.index(text_col) if text_col in keep else len(keep)
    rows = docs.select(*keep, *([] if text_col in keep else [text_col]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", lang_pred string, score double"
    sent = docs.sparkSession.sparkContext.broadcast(samples)  # bounded: about SAMPLE_CHARS a language

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_only()
        parser = CrossParser(sent.value)  # gone with the task: workers go on to other stages
        for batch in batches:
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            blocks = np.cumsum(lengths) // STEP_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(lengths)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(start, end - start)
                if part.num_rows:
                    names, score = parser.predict(part.column(at).to_pylist())
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(names, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return rows.mapInArrow(predict, schema)


def op10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text", (fraction_of(F.col("doc_id"), 5) == 0).alias("held_out")), learn_samples(docs), keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")
