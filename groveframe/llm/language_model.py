"""Language-model scores of documents: a unigram base from counts over the whole corpus, and a causal self-attention model.

A first job counts, over all training documents, each edge from the subwords of a word so far to its next one. These counts grow
with the corpus; words, subwords and pairs of subwords follow from them. The frequent ones become the model's prior: what the
beginning of a word says of its next subword. The attention adds what earlier words say. It starts from a sample of whole
documents (of ``sample_size`` subwords), which also tells the groups of subwords, and is then trained on all windows of all training
documents: a job goes through them, each task from the same start, and the mean of the tasks is the model. A last job scores every
document: overlapping windows give each subword one log probability.

The unigram base needs the count of every word of every document. The ``FREQUENT`` most frequent words go to all tasks; the
others, which by their rank occur in no more than a small part of the corpus, are joined with the counts by word.

Words are known by a 64-bit hash of their subwords. Defined cases: null texts count as empty and consist of the end alone; without
training documents all counts are 0; an empty table gives an empty result; rows with equal ids get a result each; a null id counts
as the empty text when it is dealt to a fold; texts of any length are scored whole; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_model as am
from .common import fraction_of, materialize, table
from .spelling import BACKOFF, SHIFT, STARTS, Prior, Speller, Words, build_prior, found, summed

#: The sample of the attention: subwords of a small corpus, the corpus of which the cube root doubles them, steps at the least size.
FREQUENT, TRAIN_SUBWORDS, TRAIN_DOUBLES, STEPS = 100_000, 3_000_000, 1500**3, 2000
#: Frequent edges, pairs and prefixes that the model holds; all others fall back to shorter contexts.
EDGES, PAIRS, ROWS = 400_000, 200_000, 32_768
LOW = (1 << SHIFT) - 1

#: Bytes of text whose words are taken together, and edges that a task holds before it sends them on.
CHUNK, HELD = 8_000_000, 3_000_000

#: Rows of summed parameters that the driver takes.
SUMS = 16

_SPELLERS: dict[str, Speller] = {}


def speller(tokenizer: str) -> Speller:
    if tokenizer not in _SPELLERS:
        _SPELLERS[tokenizer] = Speller(tokenizer)
    return _SPELLERS[tokenizer]


def chunks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about CHUNK bytes of text; a longer text is one of its own."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(ends // CHUNK)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def sample_size(total: int) -> float:
    """Subwords that the attention starts from: all of a small corpus, 3.9 million of 10^8, 46 million of 10^13, which the driver can hold."""
    return min(total, TRAIN_SUBWORDS * (1 + (total / TRAIN_DOUBLES) ** (1 / 3)))


def corpus_counts(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(prefix, cell, n): counts of all edges over all texts; the ends of texts have the prefix 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held):
            found = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for at in range(0, len(found[0]), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 17)]) for x in found], ["prefix", "cell", "n"])

        known, held = speller(tokenizer), []
        for batch in batches:
            for part in chunks(batch, 0):
                held.append(known.read(part.column(0)).edges())
                held.append((np.array([0]), np.array([known.stop << SHIFT | known.stop]), np.array([part.num_rows])))
                if sum(len(x[0]) for x in held) > HELD:
                    yield from rows(held)
                    held = []
        if held:
            yield from rows(held)

    return texts.mapInArrow(run, "prefix long, cell long, n long").groupBy("prefix", "cell").agg(F.sum("n").alias("n"))


def frequent(rows: DataFrame, most: int) -> DataFrame:
    """The rows of the highest counts n, at most so many: whole steps of a quarter of an octave, so ties go together."""
    level = F.floor(F.log2("n") * 4)
    least, held = None, 0
    for r in sorted(rows.groupBy(level.alias("level")).count().collect(), reverse=True):
        held += r["count"]
        if held > most:
            break
        least = r["level"]
    return rows.where(level >= least) if least is not None else rows.where(F.lit(False))


def collected(rows: DataFrame, *names: str) -> tuple[np.ndarray, ...]:
    """Columns of a bounded table, in the order of the first two."""
    got = rows.select(*names).toArrow()
    columns = [got.column(c).to_numpy() for c in names]
    order = np.lexsort(columns[1::-1])
    return tuple(c[order] for c in columns)


class LanguageModel:
    def __init__(self, prior: Prior, parameters: dict[str, np.ndarray]):
        self.prior, self.parameters = prior, parameters

    def describe(self, words: Words) -> tuple[np.ndarray, ...]:
        """Of all subwords of some words: input id, group, context after it."""
        after = np.empty_like(words.before)
        after[:-1] = words.before[1:]
        after[words.starts[1:] - 1] = words.whole
        pieces = words.pieces
        return self.prior.ids[pieces], self.prior.group[pieces], self.prior.context(after, pieces)

    def within(self, words: Words) -> np.ndarray:
        """log10 probability of all subwords of some words in their groups; only scores need it, no training does."""
        return self.prior.place(words.before, words.last(), words.pieces).astype(np.float32)

    def sequence(self, facts: tuple[np.ndarray, ...], at: np.ndarray, lengths: np.ndarray) -> am.Sequence:
        """Texts with their ends: ``at`` are the places of all their subwords in the table, one after another."""
        stops = np.cumsum(lengths)
        stop_group = self.prior.group[-1]
        groups = np.insert(facts[1][at], stops, stop_group) if len(lengths) else np.zeros(0, np.int16)
        ids, contexts = np.full(len(groups), am.PAD, np.int32), np.full(len(groups), self.prior.text_start, np.int32)
        inner = np.ones(len(groups), bool)
        inner[stops - lengths + np.arange(len(lengths))] = False
        ids[inner], contexts[inner] = facts[0][at], facts[2][at]
        return am.Sequence(ids, contexts, groups.astype(np.int64), lengths + 1)

    def prior_without(self, sequence: am.Sequence):
        """The prior of places of a training sequence: what an occurrence itself adds to the counts of its context is taken off."""
        rows, context, group = self.prior.rows, sequence.contexts, sequence.groups
        starts = group < STARTS
        share = np.where(starts, rows[:, :STARTS].sum(1)[context], rows[context, group])
        left = np.maximum(1 - 1 / ((self.prior.total[context] + BACKOFF) * share), 0.02).astype(np.float32)
        # of a start all starts are scaled, of another group that group alone
        of_starts, of_group = np.where(starts, left, np.float32(1)), np.where(starts, np.float32(1), left)

        def prior_of(places: np.ndarray) -> np.ndarray:
            out = rows.take(context[places], 0)
            out[:, :STARTS] *= of_starts[places, None]
            out.ravel()[np.arange(len(places)) * am.GROUPS + group[places]] *= of_group[places]
            return out

        return prior_of

    def fit(self, sequence: am.Sequence, steps: int) -> None:
        """Trains the attention from its start."""
        self.parameters = am.train(sequence, self.prior_without(sequence), steps)

    def texts(self, words: Words, n: int) -> am.Sequence:
        """``n`` texts with their ends, of the words read from them."""
        places, per_word = words.places(words.numbers)
        return self.sequence(self.describe(words), places, np.bincount(np.repeat(np.arange(n), words.sizes), per_word, n).astype(np.int64))

    def score(self, facts: tuple[np.ndarray, ...], within: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of each text with its end."""
        owner = np.repeat(np.arange(len(lengths)), lengths)
        places = np.bincount(owner, within[at], len(lengths)) + np.log10(self.prior.first[-1])
        return am.score_texts(self.parameters, self.sequence(facts, at, lengths), self.prior.rows) / np.log(10) + places


def learn(training: DataFrame, counts: DataFrame, tokenizer: str, steps: int = STEPS) -> LanguageModel:
    """The prior from the counts of the corpus, the start of the attention from a sample of whole documents."""
    known = speller(tokenizer)
    piece = F.col("cell").bitwiseAND(F.lit(LOW))
    starts = F.col("prefix") == 0
    seen = counts.groupBy(piece.alias("piece")).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(starts, F.col("n"))), F.lit(0)).alias("first")).collect()  # at most the vocabulary
    units, firsts = {r["piece"]: r["n"] for r in seen}, np.zeros(known.stop + 1)
    for r in seen:
        firsts[r["piece"]] = r["first"]
    edges = collected(frequent(counts, EDGES), "prefix", "cell", "n")
    pairs = collected(frequent(counts.where(~starts).groupBy("cell").agg(F.sum("n").alias("n")), PAIRS), "cell", "n")
    total = sum(n for p, n in units.items() if p != known.stop)
    wanted = sample_size(total)
    share = int(wanted / max(1, total) * (1 << 30))
    # by id and text, and each of them once: of rows without an id, of one id or of one text no more are drawn than of others
    drawn = training.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share).select("doc_id", "text").distinct().collect()
    drawn.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""))
    words = known.read(pa.array([r["text"] for r in drawn], pa.string()))
    places, per_word = words.places(words.numbers)
    lengths = np.bincount(np.repeat(np.arange(len(drawn)), words.sizes), per_word, len(drawn)).astype(np.int64)
    sample = np.split(words.pieces[places], np.cumsum(lengths)[:-1]) if drawn else []
    model = LanguageModel(build_prior(known.stop, units, firsts, edges, pairs, sample, am.INPUTS, ROWS), am.init())
    if drawn:
        model.fit(model.sequence(model.describe(words), places, lengths), int(steps * max(1.0, wanted / TRAIN_SUBWORDS)))
    return model


def go_through(model: LanguageModel, training: DataFrame, tokenizer: str) -> None:
    """Trains the attention further on all windows of all training documents, each once, in Spark.

    Each task goes on from the same parameters over its documents; the model gets the mean of what the tasks arrive at, weighed by their
    windows. Means are summed in tasks first, so the driver takes SUMS rows.
    """
    sent, names = training.sparkSession.sparkContext.broadcast(model), sorted(model.parameters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, known, n, nth = sent.value, speller(tokenizer), 0, 0
        learner = am.Learner(model.parameters)
        for part in (p for batch in batches for p in chunks(batch, 0)):
            sequence = model.texts(known.read(part.column(0)), part.num_rows)
            n, nth = n + learner.go_through(sequence, model.prior_without(sequence), seed=nth), nth + 1
        if n:
            flat = np.concatenate([learner.p[k].ravel() for k in names]).astype(np.float64) * n
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([part % SUMS]), pa.array([n]), pa.array([flat], pa.list_(pa.float64()))], ["part", "share", "n", "p"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, flat = 0, None
        for batch in batches:
            for k, p in zip(batch.column("n").to_pylist(), batch.column("p"), strict=True):
                more = p.values.to_numpy()
                n, flat = n + k, more if flat is None else flat + more
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([flat], pa.list_(pa.float64()))], ["n", "p"])

    each = materialize(training.select("text").mapInArrow(run, "part long, share long, n long, p array<double>"), "model-parts")
    sums = each.repartition(SUMS, "share").sortWithinPartitions("part").mapInArrow(total, "n long, p array<double>").collect()
    if sums:
        mean, at, before = np.sum([r["p"] for r in sums], axis=0) / sum(r["n"] for r in sums), 0, model.parameters
        model.parameters = {}
        for k in names:
            model.parameters[k] = mean[at : at + before[k].size].reshape(before[k].shape).astype(np.float32)
            at += before[k].size


def model_scores(docs: DataFrame, tokenizer: str, held_out: tuple[int, int] = (5, 1), steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    folds, fold = held_out
    rows = docs.select("doc_id", "text", (fraction_of(F.col("doc_id"), folds) == fold).alias("held_out"))
    training = rows.where(~F.col("held_out"))
    counts = materialize(corpus_counts(training.select("text"), tokenizer), "word-counts")
    stop = speller(tokenizer).stop
    # a word is the prefix of all its subwords, followed by the stop; the end of texts is the stop at the start
    words = counts.where(F.col("cell").bitwiseAND(F.lit(LOW)) == stop).select("prefix", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    model = learn(training, counts, tokenizer, steps)
    go_through(model, training, tokenizer)
    top = collected(frequent(words, FREQUENT), "prefix", "n")
    order = np.argsort(top[0])
    sent = docs.sparkSession.sparkContext.broadcast((model, top[0][order], top[1][order]))  # bounded: FREQUENT words and the tables of the model
    base = np.log10(max(total + 0.5 * (distinct + 1), 1e-9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .shingle_join import lists

        model, keys, counts = sent.value
        row, known, logs = TaskContext.get().partitionId() << 40, speller(tokenizer), np.log10(counts + 0.5) - base
        end = np.searchsorted(keys, 0)
        end = logs[end] if end < len(keys) and keys[end] == 0 else None
        for part in (p for batch in batches for p in chunks(batch, 1)):
            words = known.read(part.column(1))
            facts, within = model.describe(words), model.within(words)
            place, there = found(keys, words.whole.view(np.int64))
            value = np.where(there, logs[place] if len(logs) else 0.0, 0.0)
            stops = np.cumsum(words.sizes)
            for at in range(0, part.num_rows, 256):
                some, sizes = part.slice(at, 256), words.sizes[at : at + 256]
                numbers = words.numbers[stops[at] - sizes[0] : stops[at + len(sizes) - 1]]
                places, per_word = words.places(numbers)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                score = model.score(facts, within, places, np.bincount(owner, per_word, len(sizes)).astype(np.int64))
                sums = np.bincount(owner, value[numbers], len(sizes)) + (end or 0.0)
                n_known = np.bincount(owner, there[numbers], len(sizes)).astype(np.int64) + (end is not None)
                rare = ~there[numbers]
                rest = np.split(words.whole[numbers[rare]].view(np.int64), np.cumsum(np.bincount(owner[rare], minlength=len(sizes)))[:-1])
                if end is None:
                    rest = [np.append(r, 0) for r in rest]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(sizes))), some.column(0), some.column(2), pa.array(sizes + 1, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums), pa.array(score), lists(rest, pa.int64())],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rest"],
                )
                row += len(sizes)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rest array<long>"
    scored = materialize(rows.mapInArrow(run, schema), "model-scores")
    rare = scored.select("row", F.explode("rest").alias("prefix")).join(words, "prefix", "left")
    sums = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5) - F.lit(float(base))).alias("more"), F.count("n").alias("more_known"))
    joined = scored.drop("rest").join(sums, "row", "left")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return model_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
