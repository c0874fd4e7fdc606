"""Words as series of subwords, and what the corpus says of the next subword within a word.

A prefix of a word is known by a 64-bit hash; a whole word is the prefix of all its subwords. An edge is (prefix, last subword,
next subword), where the next may be the end of the word; the counts of all edges of a corpus hold the counts of its words, of its
subwords and of pairs of subwords.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shingle_join import mix

#: Fixed value of the byte-level BPE files: how a text is split before merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bits of a subword in a cell (last subword, next subword).
SHIFT = 20
#: Groups of subwords that begin a word, and of all others.
STARTS, INNER = 40, 32
#: Weight of the shorter context against the counts of the longer one.
BACKOFF = 5.0


def child(prefix: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """The prefix with one more subword."""
    with np.errstate(over="ignore"):
        return mix(prefix * np.uint64(0x9E3779B97F4A7C15) + piece.astype(np.uint64) + np.uint64(1))


@dataclass
class Words:
    """The words of some texts, equal ones once: the subwords of each, the prefix before each subword, the prefix that is the word."""

    numbers: np.ndarray  # the word of each occurrence, text by text
    sizes: np.ndarray  # words of each text
    starts: np.ndarray
    pieces: np.ndarray
    before: np.ndarray
    whole: np.ndarray
    stop: int

    def places(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the subwords of the words are in ``pieces``, and how many each word has."""
        sizes = self.starts[numbers + 1] - self.starts[numbers]
        return np.repeat(self.starts[numbers] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum())), sizes

    def last(self) -> np.ndarray:
        """The subword before each one, the stop for first ones."""
        out = np.empty(len(self.pieces), np.int64)
        out[1:] = self.pieces[:-1]
        out[self.starts[:-1]] = self.stop
        return out

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(prefix, cell, n) of all occurrences, each edge once."""
        times = np.bincount(self.numbers, minlength=len(self.whole))
        prefix = np.concatenate([self.before, self.whole]).view(np.int64)
        cell = np.concatenate([self.last() << SHIFT | self.pieces, self.pieces[self.starts[1:] - 1].astype(np.int64) << SHIFT | self.stop])
        return summed(prefix, cell, np.concatenate([np.repeat(times, np.diff(self.starts)), times]))


def summed(prefix: np.ndarray, cell: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal edges as one, with the sum of their counts."""
    order = np.argsort(mix(prefix.view(np.uint64) ^ mix(cell.view(np.uint64))))
    prefix, cell, n = prefix[order], cell[order], n[order]
    first = np.flatnonzero(np.append(True, (prefix[1:] != prefix[:-1]) | (cell[1:] != cell[:-1]))) if len(n) else np.zeros(0, np.int64)
    return prefix[first], cell[first], np.add.reduceat(n, first) if len(n) else n


class Speller:
    """Splits texts into words and words into subwords; equal words of a call are encoded once, all as one text."""

    def __init__(self, tokenizer: str):
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoder = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.begins = np.zeros(max(ranks.values()) + 1, bool)  # subwords with a blank before them: the first ones of words
        self.begins[[i for b, i in ranks.items() if b.startswith(b" ")]] = True
        self.stop = len(self.begins)  # the end of a word, and as first subword of a word the end of a text

    def read(self, texts: pa.Array) -> Words:
        """The words of texts, by ASCII white space, A-Z in lower case; null texts have none."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        found = lists.flatten().dictionary_encode()
        numbers, owner = found.indices.to_numpy(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
        empty = pc.index(found.dictionary, "").as_py()  # before white space at the start and after it at the end
        words = found.dictionary
        if empty >= 0:
            owner, numbers = owner[numbers != empty], numbers[numbers != empty]
            numbers = numbers - (numbers > empty)
            words = pa.concat_arrays([words[:empty], words[empty + 1 :]])
        pieces, starts = self.encode(words)
        before, whole = prefixes(pieces, starts)
        return Words(numbers, np.bincount(owner, minlength=len(texts)), starts, pieces, before, whole, self.stop)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The subwords of all words, each with a blank before it, and where each begins.

        No subword goes on past a blank that words follow, so the words are encoded as one text; only words that begin or end with
        other kinds of blanks may differ there, which shows in the number of beginnings.
        """
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        pieces = np.array(self.encoder.encode_ordinary(" " + joined), np.int32)
        starts = np.flatnonzero(self.begins[pieces])
        if len(starts) == len(words):
            return pieces, np.append(starts, len(pieces))
        parts = [self.encoder.encode_ordinary(" " + w) for w in words.to_pylist()]
        return np.array([i for p in parts for i in p], np.int32), np.cumsum([0, *map(len, parts)])


def prefixes(pieces: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefix before each subword, and that of each whole word."""
    before, state, sizes = np.zeros(len(pieces), np.uint64), np.zeros(len(starts) - 1, np.uint64), np.diff(starts)
    live, k = np.flatnonzero(sizes > 0), 0
    while len(live):
        at = starts[live] + k
        before[at] = state[live]
        state[live] = child(state[live], pieces[at])
        k += 1
        live = live[sizes[live] > k]
    return before, state


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted value among the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def edge_key(prefix: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return child(prefix, piece) if len(prefix) else np.zeros(0, np.uint64)


def grouped(profiles: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """Groups of about equal weight of rows with similar profiles: halved again and again along their main direction."""
    out, parts = np.zeros(len(profiles), np.int64), [np.arange(len(profiles))]
    while len(parts) < most and max(map(len, parts)) > 1:
        heavy = max(range(len(parts)), key=lambda i: (weights[parts[i]].sum() if len(parts[i]) > 1 else -1.0))
        rows = parts.pop(heavy)
        x = profiles[rows] - profiles[rows].mean(0)
        along = x @ np.linalg.eigh(x.T @ x)[1][:, -1]
        order = np.argsort(along, kind="stable")
        half = np.searchsorted(np.cumsum(weights[rows[order]]), weights[rows].sum() / 2)
        cut = min(max(1, int(half)), len(rows) - 1)
        parts += [rows[order[:cut]], rows[order[cut:]]]
    for i, rows in enumerate(parts):
        out[rows] = i
    return out


@dataclass
class Prior:
    """Probabilities of groups in each context, and of a subword within its group.

    Contexts are the most frequent prefixes, then the last subword (as an input id of the model), then the start of a text. A
    start of a word is reached through the end of the word before: its group does not depend on the prefix, but on what the
    attention makes of earlier words.
    """

    ids: np.ndarray  # subword -> input id
    group: np.ndarray  # subword, or the stop -> group
    keys: np.ndarray  # sorted prefixes with a row of their own
    rows: np.ndarray  # contexts x groups: probabilities
    total: np.ndarray  # occurrences of each context
    inner: np.ndarray  # prefixes x inner groups: occurrences
    edges: tuple[np.ndarray, np.ndarray]  # sorted edge keys, occurrences
    pairs: tuple[np.ndarray, np.ndarray]  # sorted cells, occurrences
    by_last: np.ndarray  # input ids x inner groups: occurrences
    within: np.ndarray  # subword -> probability within its group, as an inner subword
    first: np.ndarray  # subword or stop -> probability within its group, as the first of a word
    name: str = field(default_factory=lambda: uuid4().hex)

    @property
    def text_start(self) -> int:
        return len(self.rows) - 1

    def context(self, prefix: np.ndarray, last: np.ndarray) -> np.ndarray:
        at, there = found(self.keys, prefix)
        return np.where(there, at, len(self.keys) + self.ids[last]).astype(np.int32)

    def place(self, prefix: np.ndarray, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """log10 probability of subwords within their groups; ``last`` is the stop for the first one of a word."""
        starts = last == len(self.ids)
        out = np.log10(self.first[piece])
        i = np.flatnonzero(~starts)
        prefix, last, piece = prefix[i], last[i], piece[i]
        g = np.maximum(self.group[piece] - STARTS, 0)
        at, there = found(self.pairs[0], last.astype(np.int64) << SHIFT | piece)
        own = self.ids[last] > 0  # the others share an input id
        p = (np.where(there & own, self.pairs[1][at] if len(self.pairs[1]) else 0, 0) + BACKOFF * self.within[piece]) / (np.where(own, self.by_last[self.ids[last], g], 0) + BACKOFF)
        row, known = found(self.keys, prefix)
        at, there = found(self.edges[0], edge_key(prefix, piece))
        n = self.inner[np.where(known, row, 0), g] if len(self.inner) else np.zeros(len(i))
        longer = (np.where(there & known, self.edges[1][at] if len(self.edges[1]) else 0, 0) + BACKOFF * p) / (np.where(known, n, 0) + BACKOFF)
        out[i] = np.log10(longer)
        return out


def build_prior(stop: int, units: dict[int, int], firsts: np.ndarray, edges: tuple, pairs: tuple, sample: list[np.ndarray], inputs: int, most_rows: int) -> Prior:
    """A prior from counts: of subwords, of first subwords (by subword, the stop being the end of texts), frequent edges and pairs.

    ``sample`` are the subwords of sampled texts: subwords that occur in the same texts come into the same group.
    """
    n_unit = np.zeros(stop + 1)
    n_unit[list(units)] = list(units.values())
    n_first, n_inner = firsts.astype(float), n_unit - firsts
    n_inner[stop] = 0
    top = np.argsort(-n_unit[:stop], kind="stable")[: inputs - 1]
    ids = np.zeros(stop, np.int32)
    ids[top[n_unit[top] > 0]] = 1 + np.arange(int((n_unit[top] > 0).sum()))
    # profile of a subword: random signs of the texts it occurs in, weighed by how much of its occurrences they hold
    rng, profile = np.random.default_rng(3), np.zeros((stop + 1, 96))
    for text in sample:
        piece, n = np.unique(np.append(text, stop), return_counts=True)
        profile[piece] += np.sqrt(n)[:, None] * rng.choice([-1.0, 1.0], 96)
    size = np.linalg.norm(profile, axis=1)
    group = np.full(stop + 1, STARTS + INNER - 1, np.int64)
    begins = n_first > 0
    for chosen, weights, base, most in ((begins, n_first, 0, STARTS), (~begins, n_inner, STARTS, INNER)):
        rows = np.flatnonzero(chosen & (size > 0))
        if len(rows):
            group[rows] = base + grouped(profile[rows] / size[rows, None], weights[rows], most)
    group[begins & (size == 0)] = STARTS - 1
    group[stop] = group[stop] if group[stop] < STARTS else 0

    def share(counts, alpha=0.5):
        per_group = np.bincount(group, counts, STARTS + INNER) + alpha * np.bincount(group, minlength=STARTS + INNER)
        return (counts + alpha) / per_group[group]

    start_share = np.bincount(group, n_first, STARTS + INNER)[:STARTS] + 0.5
    start_share /= start_share.sum()
    events = INNER + 1  # inner groups, then the end of the word

    def event(piece):
        # first subwords may also occur within words: they count with the last inner group
        return np.where(piece == stop, INNER, np.where(group[piece] >= STARTS, group[piece] - STARTS, INNER - 1))

    cell, n_pair = pairs
    last, piece = cell >> SHIFT, cell & ((1 << SHIFT) - 1)
    mid = last < stop
    by_last = np.zeros((inputs, events))
    np.add.at(by_last, (ids[last[mid]], event(piece[mid])), n_pair[mid])
    overall = by_last.sum(0) + 0.5
    overall /= overall.sum()
    shorter = (by_last + BACKOFF * overall) / (by_last.sum(1, keepdims=True) + BACKOFF)

    prefix, cell, n_edge = edges
    last, piece = cell >> SHIFT, cell & ((1 << SHIFT) - 1)
    inner = prefix != 0
    prefix, last, piece, n_edge = prefix[inner].view(np.uint64), last[inner], piece[inner], n_edge[inner]
    keys, one, back = np.unique(prefix, return_index=True, return_inverse=True)
    sums = np.bincount(back, n_edge, len(keys))
    keep = np.sort(np.argsort(-sums, kind="stable")[:most_rows])
    number = np.full(len(keys), -1)
    number[keep] = np.arange(len(keep))
    here = number[back] >= 0 if len(keys) else np.zeros(0, bool)
    counts = np.zeros((len(keep), events))
    np.add.at(counts, (number[back[here]], event(piece[here])), n_edge[here])
    base = shorter[ids[last[one[keep]]]] if len(keep) else np.zeros((0, events))
    own = (counts + BACKOFF * base) / (counts.sum(1, keepdims=True) + BACKOFF)
    all_rows = np.concatenate([own, shorter])
    rows = np.concatenate([all_rows[:, INNER:] * start_share, all_rows[:, :INNER]], 1)
    rows = np.concatenate([rows, np.append(start_share, np.full(INNER, 1e-9))[None]]).astype(np.float32)
    total = np.concatenate([counts.sum(1), np.full(inputs + 1, np.inf)]).astype(np.float32)
    key = edge_key(prefix[here], piece[here])
    order = np.argsort(key)
    cells = np.argsort(pairs[0])
    return Prior(
        ids, group.astype(np.int16), keys[keep], rows, total, counts[:, :INNER].astype(np.float32), (key[order], n_edge[here][order].astype(np.float32)),
        (pairs[0][cells], n_pair[cells].astype(np.float32)), by_last[:, :INNER].astype(np.float32), share(n_inner), share(n_first),
    )
