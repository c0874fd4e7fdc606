"""Fuzzy passages that repeat across documents: k-mer seeds, collinear chaining, alignment.

Seeds are runs of ``K`` words, sampled as minimisers of ``SPAN`` consecutive runs: any ``K + SPAN - 1`` equal words share one, and
the choice depends on the text alone. Documents that share a seed are matched with the first one that has it, not with each
other. A hot seed is dealt to shares of the documents, the first ones of the shares are then matched among themselves. So a
passage that a third of all documents hold costs a row for each of them and no task takes them all.

Earlier documents may quote a passage in fragments, each too short to report, so that its seeds lead to all of them and to no whole
copy. So seeds that no reported passage covers are looked at again: where another document has the same ``WIDE`` words from a seed
on, all runs of ``LEAST_WORDS`` words around it are matched with the first document that has the run. A run is a whole passage, no
fragment has one, and any ``LEAST_WORDS`` equal words hold a seed with ``WIDE`` words after it: none is missed, in linear work.

Edited copies may have no such run. So seeds that are still open are looked up in pairs, ``NEAR`` to ``MOST_GAP`` words apart, with the
first document that has both: fragments have no two seeds so far apart. What is found only by seeds nearer to each other than
that, or whose pairs all come first in another document that has no passage there, is not.

All places of a seed in a document count: each is matched with the first place in the other document, and the n-th place that
is clear of the ones before it also with the n-th there, so a run of one word, in which all seeds are equal, makes a chain.

The matches of two documents are chained: ordered in both, weighed by the words they cover less a cost for the words between
them. A Fenwick tree over positions in the second document answers the best predecessor. Chains are cut at gaps of over
``MOST_GAP`` words, then aligned: exact words at both ends extend them, and the words between matches are aligned by their
longest common subsequence. Passages of at least ``LEAST_WORDS`` words with ``LEAST_IDENTITY`` of them equal are reported, with
the document they repeat; other documents with the passage are linked to the same one.

Defined cases: words are runs of other than ASCII white space after lower-casing A-Z; null texts and texts of fewer than ``K``
words have no seeds; rows with equal ids are one document, and passages repeated only within it are not reported; rows with a null id are left out, since a passage could not be assigned;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hot_keys, in_sample, materialize, table, with_shares
from .shingle_join import _WORDS, lists, mix

K, SPAN = 6, 10
GAP_COST, MOST_GAP, LEAST_CHAIN = 0.1, 100, 10.0
#: Least distance of two seeds that are looked up as a pair.
NEAR = 25
LEAST_WORDS, LEAST_IDENTITY, MARGIN, DROP = 50, 0.8, 40, 4
#: Words from a seed on that lie within any passage of the least length, wherever its first seed is.
WIDE = LEAST_WORDS - SPAN + 1
#: Odd multiplier of the hash of a run of words, and its inverse modulo 2^64.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
NONE = np.iinfo(np.int32).min
#: Document ids that are sent to all tasks (8 MB); more of them are joined by a shuffle.
MOST_IDS = 1_000_000
SCHEMA = "doc_id long, start_word int, end_word int, repeats_doc_id long, repeats_start int, repeats_end int, identity double"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def word_hashes(text: str | None) -> np.ndarray:
    return hashes_of(words_of(text))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def run_keys(hashes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of ``length`` words that begin at the given places, all of them within the text."""
    with np.errstate(over="ignore"):
        sums = np.append(np.uint64(0), np.cumsum(hashes * powers(STEP, len(hashes))))
        return mix((sums[at + length] - sums[at]) * powers(BACK, len(hashes) + 1)[at] + np.uint64(length)).view(np.int64)


def minimisers(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and positions of the sampled seeds of a document.

    Of equal seeds those that are clear of the one before count. The n-th of them, from the second on, also has a key of its number.
    """
    n = len(hashes) - K + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    keys = np.full(n, K, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(K):
            keys = mix(keys + hashes[i : i + n] + np.uint64(0x9E3779B97F4A7C15))
    span = min(SPAN, n)
    least = np.lib.stride_tricks.sliding_window_view(keys, span).argmin(1) + np.arange(n - span + 1)
    at = np.unique(least)
    order = np.argsort(keys[at], kind="stable")
    at = at[order]
    first = np.append(True, keys[at[1:]] != keys[at[:-1]])
    if first.all():
        return keys[at].view(np.int64), at.astype(np.int32)
    rank = np.zeros(len(at), np.int64)
    last = number = 0
    for i in np.flatnonzero(~first | np.append(~first[1:], False)).tolist():  # the equal ones, in order of key and position
        if first[i]:
            last, number = int(at[i]), 0
        elif at[i] - last >= K:
            last, number = int(at[i]), number + 1
            rank[i] = number
        else:
            rank[i] = -1
    kept, later = rank >= 0, rank > 0
    with np.errstate(over="ignore"):
        both = np.concatenate([keys[at[kept]], mix(keys[at[later]] + rank[later].astype(np.uint64))])
    return both.view(np.int64), np.concatenate([at[kept], at[later]]).astype(np.int32)


def seeds(docs: DataFrame) -> DataFrame:
    """(key, doc, pos, wide) of all documents; ``wide`` is a short hash of ``WIDE`` words from the seed on, null at the end of a text.

    It only tells which seeds are looked at again, always beside the key.
    """

    def wide(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), NONE, np.int32)
        inside = at + WIDE <= len(hashes)
        if inside.any():
            out[inside] = np.maximum(run_keys(hashes, at[inside], WIDE).astype(np.int32), NONE + 1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                hashes = [word_hashes(t) for t in part.column(1).to_pylist()]
                found = [minimisers(h) for h in hashes]
                owner = np.repeat(part.column(0).to_numpy(), [len(k) for k, _ in found])
                wides = np.concatenate([wide(h, p) for h, (_, p) in zip(hashes, found, strict=True)])
                columns = [pa.array(np.concatenate([k for k, _ in found])), pa.array(owner, pa.int64()), pa.array(np.concatenate([p for _, p in found]))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(wides, mask=wides == NONE)], ["key", "doc", "pos", "wide"])

    return docs.mapInArrow(run, "key long, doc long, pos int, wide int")


class MaxTree:
    """Fenwick tree of prefix maxima with the index that holds each."""

    def __init__(self, size: int):
        self.best = [(-1e18, -1)] * (size + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at] = value
            at += at & -at

    def top(self, at: int) -> tuple[float, int]:
        out = (-1e18, -1)
        while at > 0:
            out = max(out, self.best[at])
            at -= at & -at
        return out


def chains(pos: np.ndarray, ref: np.ndarray) -> list[np.ndarray]:
    """Disjoint collinear chains of matches, best first, as indices into the matches."""
    order = np.lexsort((-ref, pos))
    ranks = np.unique(ref, return_inverse=True)[1] + 1
    tree, score, before = MaxTree(int(ranks.max())), np.zeros(len(pos)), np.full(len(pos), -1)
    for i in order.tolist():
        value, j = tree.top(int(ranks[i]) - 1)
        value -= GAP_COST * (pos[i] + ref[i])
        score[i], before[i] = (K + value, j) if value > 0 else (K, -1)
        tree.put(int(ranks[i]), (score[i] + GAP_COST * (pos[i] + ref[i]), i))
    out, used = [], np.zeros(len(pos), bool)
    for i in np.argsort(-score, kind="stable").tolist():
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = int(before[i])
        chain = np.array(chain[::-1])
        if len(chain) > 1:
            cuts = np.flatnonzero((np.diff(pos[chain]) > MOST_GAP) | (np.diff(ref[chain]) > MOST_GAP)) + 1
            out += [c for c in np.split(chain, cuts) if len(c) > 1 and K + pos[c[-1]] - pos[c[0]] >= LEAST_CHAIN]
    return out


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a row of the table at a time."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return int(row[-1])


def extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How far two sequences run alike from their start, over single differing words: words and equal words."""
    n = min(len(a), len(b))
    gain = np.cumsum(np.where(a[:n] == b[:n], 1, -1))
    if not n or gain.max() <= 0:
        return 0, 0
    fall = np.flatnonzero(np.maximum.accumulate(gain) - gain > DROP)
    far = int(gain[: fall[0] if len(fall) else n].argmax()) + 1
    return (far, int((a[:far] == b[:far]).sum())) if gain[far - 1] > 0 else (0, 0)


def align(a: np.ndarray, a0: int, b: np.ndarray, b0: int, pos: np.ndarray, ref: np.ndarray) -> tuple[int, int, int, int, float] | None:
    """Bounds in both documents and identity of a chain; ``a`` and ``b`` are words from positions a0 and b0 on."""
    p, r = pos - a0, ref - b0
    if p[-1] + K > len(a) or r[-1] + K > len(b) or (a[p[0] : p[0] + K] != b[r[0] : r[0] + K]).any():
        return None
    left, left_same = extend(a[: p[0]][::-1], b[: r[0]][::-1])
    right, right_same = extend(a[p[-1] + K :], b[r[-1] + K :])
    same = left_same + right_same + K
    for i in range(1, len(p)):
        dp, dr = int(p[i] - p[i - 1]), int(r[i] - r[i - 1])
        at, bt = p[i - 1] + K, r[i - 1] + K
        if dp == dr:
            same += int((a[at : p[i] + K] == b[bt : r[i] + K]).sum())
        else:
            same += common_length(a[at : p[i] + K], b[bt : r[i] + K])
    start, end, ref_start, ref_end = p[0] - left, p[-1] + K + right, r[0] - left, r[-1] + K + right
    return int(start + a0), int(end + a0), int(ref_start + b0), int(ref_end + b0), same / max(1, end - start, ref_end - ref_start)


def shared_seeds(rows: DataFrame) -> DataFrame:
    """(key, share, doc, pos, wide, ref, ref_pos): seeds that several documents have, each with the first document of its key and share.

    ``wide`` is left only where another document has it beside the key (of a hot seed: may have it in another share).
    """
    hot = hot_keys(seeds(rows.where(in_sample("doc_id"))).select("key", "doc").distinct())
    order, alike = (W.partitionBy(*by).orderBy("doc", "pos") for by in (("key", "share"), ("key", "share", "wide")))
    found = with_shares(seeds(rows), hot, "doc").withColumn("ref", F.first("doc").over(order)).withColumn("ref_pos", F.first("pos").over(order)).withColumn("next", F.lead("doc").over(order))
    found = found.where("doc != ref or doc != next or share > 0")
    # the second window sorts within the partitions of the first one
    found = found.withColumn("first", F.first("doc").over(alike)).withColumn("next", F.lead("doc").over(alike))
    found = found.withColumn("wide", F.when(F.expr("doc != first or doc != next or share > 0"), F.col("wide"))).drop("first", "next")
    # written once, since several branches read it: most seeds occur in one document and are gone here
    return materialize(found, "passage-matches")


def first_matches(shared: DataFrame) -> DataFrame:
    """(doc, pos, ref, ref_pos): each seed with the first document of its share; the first ones of the shares are matched in the same way."""
    order = W.partitionBy("key").orderBy("doc", "pos")
    heads = shared.where("share > 0 and doc = ref").select("key", "doc", "pos").withColumn("ref", F.first("doc").over(order)).withColumn("ref_pos", F.first("pos").over(order))
    return shared.where("doc != ref").select("doc", "pos", "ref", "ref_pos").unionByName(heads.where("doc != ref").select("doc", "pos", "ref", "ref_pos"))


def open_matches(shared: DataFrame, rows: DataFrame, reported: DataFrame) -> DataFrame:
    """(doc, pos, ref, ref_pos): both ends of the runs of ``LEAST_WORDS`` words at seeds that no reported passage of their document covers,
    with the first document that has the run."""
    spans = reported.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    places = shared.where("wide is not null").select("key", "wide", "doc", "pos")
    covered = F.exists("spans", lambda s: (F.col("pos") >= s["start_word"]) & (F.col("pos") + K <= s["end_word"]))
    places = materialize(places.join(spans, "doc", "left").select("key", "wide", "doc", "pos", (~F.coalesce(covered, F.lit(False))).alias("open")), "passage-places")
    # an open seed counts where an earlier document has its wide run too
    asked = places.groupBy("key", "wide").agg(F.min("doc").alias("first"), F.max(F.when(F.col("open"), F.col("doc"))).alias("last")).where("last > first").select("key", "wide")
    asked = places.join(asked, ["key", "wide"], "left_semi").groupBy("doc").agg(F.collect_list(F.struct("pos", "open")).alias("at"))
    asked = materialize(asked.select("doc", "at.pos", "at.open"), "passage-open")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                out = []
                for doc, text, pos, still in zip(*(batch.slice(at, 1024).column(i).to_pylist() for i in range(4)), strict=True):
                    hashes = word_hashes(text)
                    starts = (np.array(pos)[:, None] - np.arange(SPAN)).ravel()
                    keep = (starts >= 0) & (starts + LEAST_WORDS <= len(hashes))
                    starts, still = starts[keep], np.repeat(still, SPAN)[keep]
                    places = np.unique(starts)
                    if len(places):
                        out.append((np.full(len(places), doc), places.astype(np.int32), run_keys(hashes, places, LEAST_WORDS), np.isin(places, starts[still])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["doc", "pos", "run", "open"])

    texts = of_documents(rows, asked.select(F.col("doc").alias("doc_id"))).join(asked, F.col("doc_id") == F.col("doc")).select("doc", "text", "pos", "open")
    runs = materialize(texts.mapInArrow(windows, "doc long, pos int, run long, open boolean"), "passage-runs")
    heads = runs.groupBy("run").agg(F.min(F.struct("doc", "pos")).alias("head"), F.max("doc").alias("last")).where("last > head.doc").select("run", F.col("head.doc").alias("ref"), F.col("head.pos").alias("ref_pos"))
    found = runs.where("open").join(heads, "run").where("doc != ref")
    ends = F.explode(F.array(F.lit(0), F.lit(LEAST_WORDS - K))).alias("by")
    return found.select("doc", "pos", "ref", "ref_pos", ends).select("doc", (F.col("pos") + F.col("by")).alias("pos"), "ref", (F.col("ref_pos") + F.col("by")).alias("ref_pos")).distinct()


def seed_pairs(pos: list[int], *columns: list) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Numbers of all pairs of places that are ``NEAR`` to ``MOST_GAP`` words apart, and the columns in the order of the places."""
    order = np.lexsort((columns[0], pos))
    pos, *columns = (np.array(x)[order] for x in (pos, *columns))
    low, high = np.searchsorted(pos, pos + NEAR), np.searchsorted(pos, pos + MOST_GAP, "right")
    one = np.repeat(np.arange(len(pos)), high - low)
    two = np.arange(len(one)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[one]
    return one, two, [pos, *columns]


def edited_matches(shared: DataFrame, reported: DataFrame) -> DataFrame:
    """(doc, pos, ref, ref_pos): both seeds of pairs of seeds ``NEAR`` to ``MOST_GAP`` words apart in a document, with the first document that has the pair.

    A document asks for a pair where earlier ones have either seed (else none has both) and no reported passage of its own covers one of
    them. Other documents pair the seeds of pairs that are asked for.
    """
    spans = reported.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    covered = F.exists("spans", lambda s: (F.col("pos") >= s["start_word"]) & (F.col("pos") + K <= s["end_word"]))
    # the first document of a share may have earlier ones in other shares
    later = F.expr("share > 0 or doc != ref")
    places = shared.join(spans, "doc", "left").select("key", "doc", "pos", later.alias("later"), (later & ~F.coalesce(covered, F.lit(False))).alias("open"))
    places = materialize(places, "passage-places")

    def asked_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0, np.int64)]
            for columns in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                one, two, (_, key, still) = seed_pairs(*columns)
                asks = still[one] | still[two]
                out += [key[one[asks]], key[two[asks]]]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)))], ["key"])

    asking = places.where("later").groupBy("doc").agg(F.collect_list(F.struct("pos", "key", "open")).alias("at")).where(F.exists("at", lambda x: x["open"]))
    asked = materialize(asking.select("at.pos", "at.key", "at.open").mapInArrow(asked_seeds, "key long").distinct(), "passage-open")
    grouped = places.join(asked, "key", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("pos", "key", "later", "open")).alias("at")).select("doc", "at.pos", "at.key", "at.later", "at.open")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, *columns in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                one, two, (pos, key, after, still) = seed_pairs(*columns)
                if len(one):
                    key = key.view(np.uint64)
                    with np.errstate(over="ignore"):
                        both = mix(key[one] * np.uint64(STEP) + key[two]).view(np.int64)
                    asks = after[one] & after[two] & (still[one] | still[two])
                    yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(np.full(len(one), doc)), pa.array(pos[one].astype(np.int32)), pa.array(pos[two].astype(np.int32)), pa.array(asks)], ["both", "doc", "pos", "pos2", "open"])

    pairs = materialize(grouped.mapInArrow(run, "both long, doc long, pos int, pos2 int, open boolean"), "passage-pairs")
    heads = pairs.groupBy("both").agg(F.min(F.struct("doc", "pos", "pos2")).alias("head"), F.max(F.when(F.col("open"), F.col("doc"))).alias("last")).where("last > head.doc")
    heads = heads.select("both", F.col("head.doc").alias("ref"), F.col("head.pos").alias("ref_pos"), F.col("head.pos2").alias("ref_pos2"))
    found = pairs.where("open").join(heads, "both").where("doc != ref")
    ends = F.explode(F.array(F.struct(F.col("pos").alias("p"), F.col("ref_pos").alias("r")), F.struct(F.col("pos2").alias("p"), F.col("ref_pos2").alias("r")))).alias("e")
    return found.select("doc", "ref", ends).select("doc", F.col("e.p").alias("pos"), "ref", F.col("e.r").alias("ref_pos")).distinct()


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, repeats_doc_id, repeats_start, repeats_end, identity) of the passages a document repeats."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    shared = shared_seeds(rows)
    reported = materialize(aligned(first_matches(shared), rows), "passages")
    reported = materialize(reported.unionByName(aligned(open_matches(shared, rows, reported), rows)).distinct(), "passages")
    return reported.unionByName(aligned(edited_matches(shared, reported), rows)).distinct()


def of_documents(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """Rows of the documents (doc_id) that are needed, so that a join with them does not move all texts."""
    ids = materialize(needed.distinct(), "passage-documents")
    return rows.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, "doc_id", "left_semi")


def aligned(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Chains the matches of two documents, aligns the chains and keeps those that are passages."""
    grouped = pairs.groupBy("doc", "ref").agg(F.collect_list(F.struct("pos", "ref_pos")).alias("m")).where(F.size("m") > 1).select("doc", "ref", "m.pos", "m.ref_pos")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, ref, pos, ref_pos in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                p, r = np.array(sorted(zip(pos, ref_pos, strict=True)), np.int32).T  # ties of chains go by place in every attempt
                out += [(doc, ref, p[c], r[c]) for c in chains(p, r)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), lists([x[2] for x in out], pa.int32()), lists([x[3] for x in out], pa.int32())], ["doc", "ref", "pos", "ref_pos"])

    chained = grouped.mapInArrow(chain, "doc long, ref long, pos array<int>, ref_pos array<int>")
    chained = materialize(chained.withColumn("chain", F.xxhash64("doc", "ref", "pos", "ref_pos")), "passage-chains")

    def need(side: int, doc: str, pos: str) -> DataFrame:
        return chained.select("chain", F.lit(side).alias("side"), F.col(doc).alias("doc_id"), F.greatest(F.lit(0), F.element_at(pos, 1) - MARGIN).alias("low"), (F.element_at(pos, -1) + K + MARGIN).alias("high"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part, out = batch.slice(at, 2048), []
                for low, high, text in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    if text is not held and text != held:
                        held, words = text, words_of(text)
                    out.append(hashes_of(words[low:high]).astype(np.uint32).view(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], lists(out, pa.int32())], ["chain", "side", "low", "words"])

    wanted = need(0, "doc", "pos").unionByName(need(1, "ref", "ref_pos"))
    texts = wanted.join(of_documents(rows, wanted.select("doc_id")), "doc_id").select("chain", "side", "low", "high", "text").mapInArrow(cut, "chain long, side int, low int, words array<int>")
    texts = materialize(texts, "passage-words")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, ref, pos, ref_pos, a0, a, b0, b in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                got = align(np.array(a, np.int32), a0, np.array(b, np.int32), b0, np.array(pos), np.array(ref_pos))
                if got and got[1] - got[0] >= LEAST_WORDS and got[4] >= LEAST_IDENTITY:
                    out.append((doc, got[0], got[1], ref, got[2], got[3], got[4]))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start_word", "end_word", "repeats_doc_id", "repeats_start", "repeats_end", "identity"])

    one = texts.where("side = 0").select("chain", F.col("low").alias("a0"), F.col("words").alias("a"))
    two = texts.where("side = 1").select("chain", F.col("low").alias("b0"), F.col("words").alias("b"))
    both = chained.join(one, "chain").join(two, "chain").select("doc", "ref", "pos", "ref_pos", "a0", "a", "b0", "b")
    return both.mapInArrow(measure, SCHEMA).distinct()


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
