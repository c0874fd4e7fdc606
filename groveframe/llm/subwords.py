"""Encoding of many texts with a public tokenizer: equal words are encoded once."""

from __future__ import annotations

import os
from itertools import chain, pairwise

import numpy as np

from .common import kept_table, use_only

#: Words and word pieces that a worker keeps; beyond it the table starts anew.
CACHED = 1_200_000


class ByteLevelEncoder:
    """Ids of whole texts, the same as ``Tokenizer.encode(text, add_special_tokens=False)`` of a byte-level BPE file.

    Byte-level BPE never merges across a blank that separates two words, so a text of words that are separated by single blanks
    or line feeds is encoded word by word through a table of words seen before. Any other text goes to the tokenizer as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), np.dtype("<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        return self.pieces([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def pieces(self, ids: list[list[int]]) -> list[bytes]:
        """Each list as bytes."""
        ends = (np.cumsum([0, *map(len, ids)]) * self.dtype.itemsize).tolist()
        data = np.fromiter(chain.from_iterable(ids), self.dtype).tobytes()
        return [data[a:b] for a, b in pairwise(ends)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Words of letters alone, each with a blank before it: many are encoded as one text and taken apart by the tokenizer's words."""
        out: list[bytes] = []
        groups = [words[at : at + 400] for at in range(0, len(words), 400)]
        for group, e in zip(groups, self.tokenizer.encode_batch([" " + " ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ends = np.searchsorted(np.array(e.word_ids), np.arange(len(group) + 1)) * self.dtype.itemsize
            data = np.array(e.ids, self.dtype).tobytes()
            out += [data[a:b] for a, b in pairwise(ends.tolist())]
        return out

    def learn(self, new: set[str]) -> None:
        """Adds words to the table. Full stops and commas after a letter or digit are a piece of their own: only the stem is encoded."""
        stems = {w: w.rstrip(".,") for w in new}
        ends = {w: w[len(s) :] for w, s in stems.items() if len(s) < len(w) and s[-1:].isalnum()}
        plain = [w for w in {stems[w] if w in ends else w for w in new} if w not in self.words]
        letters, others = [w for w in plain if w.isalpha()], [w for w in plain if not w.isalpha()]
        self.words.update(zip(letters, self.encode_words(letters), strict=True))
        self.words.update(zip(others, self.encode_plain([w[1:] if w[0] == "^" else w if w[0] == "\n" else " " + w for w in others]), strict=True))
        marks = sorted(set(ends.values()))
        ids = dict(zip(marks, self.encode_plain(marks), strict=True))
        self.words.update((w, self.words[stems[w]] + ids[end]) for w, end in ends.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian integers."""
        out: list[bytes | None] = [None] * len(texts)
        split: list[tuple[int, list[str]]] = []
        plain: list[int] = []
        for i, text in enumerate(texts):
            if not text:
                out[i] = b""
            elif " ".join(text.split()) == text.replace("\n", " ") and "^" not in text and not any(s in text for s in self.special):
                words = text.replace("\n", " \n").split(" ")
                words[0] = "^" + words[0]  # without a blank before it; texts with this mark are not split
                split.append((i, words))
            else:
                plain.append(i)
        if len(self.words) > CACHED:
            self.words.clear()
        if split:
            self.learn(set().union(*(w for _, w in split)).difference(self.words))
        for i, words in split:
            out[i] = b"".join(map(self.words.__getitem__, words))
        for i, ids in zip(plain, self.encode_plain([texts[i] for i in plain]) if plain else [], strict=True):
            out[i] = ids
        return out


_ENCODERS: dict[tuple[str, int], ByteLevelEncoder] = kept_table("encoders", {})


def encoder_of(path: str, end_id: int) -> ByteLevelEncoder:
    """The encoder of a file, made once in a worker, with ids of two bytes where they suffice."""
    use_only("encoders")
    if (path, end_id) not in _ENCODERS:
        made = _ENCODERS[path, end_id] = ByteLevelEncoder(path)
        made.dtype = np.dtype("<u2" if max(made.tokenizer.get_vocab_size(True), end_id + 1) <= 1 << 16 else "<u4")
    return _ENCODERS[path, end_id]
