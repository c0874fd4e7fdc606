"""License scan by templates: optional and replaceable regions compiled into automata over words.

A template is the wording of a license or notice with markup: ``[...]`` is an optional region, ``{m..n}`` a replaceable one of m to n
words of any kind, ``{one|other}`` a choice, and everything else is mandatory wording. It is compiled into a nondeterministic
automaton over words, started wherever the first two words fit and followed to its longest end; a text has the license if the
automaton accepts some run of its words, so every mandatory word stands exactly and in order. Base phrases are templates without
markup, all of whose places count.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, so punctuation, case, line ends and marks of comments do
not matter. Each document is read on its own, whole, in one pass without a shuffle: no key can be hot, and copies cost what they are.
Work on a place is bounded by the length of the template with its replaceable regions filled.

The score of a document is m / (m + 8) for the most mandatory words m of what was found in it, 0 without any: the longer the exact
wording, the surer the finding.

Defined cases: a null text is empty, and an empty text has no words, labels '' and score 0; repeated rows each have their result; a
null doc_id stays null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The phrases of the base and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: The wording of licenses and notices, as their authors publish it, with the regions that may differ marked.
TEMPLATES = [
    ("mit", "[the mit license [mit]] [copyright [c] {1..30} [all rights reserved]] permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and {noninfringement|non infringement} in no event shall {1..20} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "{licensed|released|distributed|available|published} under [the terms of] the mit [x11] license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies [the software is provided as is and {1..10} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {1..10} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software]"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by {1..20} as is"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [3] neither the name of {1..20} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission [this software is provided by {1..20} as is]"),
    ("apache-2", "licensed under the apache license version 2 [0] [the license] [you may not use this file except in compliance with the license [you may obtain a copy of the license at [{1..10}]]]"),
    ("gpl-3", "this {program|library|file|software} is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or [at your option] any later version"),
    ("gpl-3", "licensed under [the terms of] the gnu [general public license] {gpl|license|general public license} version 3 [of the license] [or [at your option] any later version]"),
    ("gpl-2", "this {program|library|file|software} is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or [at your option] any later version"),
    ("lgpl-3", "licensed under [the terms of] the gnu lesser general public license version 3 [of the license] [or [at your option] any later version]"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license [v] [version] {2|2 0} if a copy of the mpl was not distributed with this file you can obtain one at {1..10}"),
    ("cc-by-nc", "licensed under [a] [the] [creative commons] {cc by nc|attribution noncommercial|attribution non commercial} [{2|3|4} {0|5}] [international] [unported] [license]"),
    ("cc-by", "licensed under [a] [the] creative commons attribution [{2|3|4} {0|5}] {international license|unported license|license}"),
    ("cc-by-sa", "licensed under [a] [the] [creative commons] {cc by sa|attribution sharealike|attribution share alike} [{2|3|4} {0|5}] [international] [unported] [license]"),
    ("cc0", "{dedicated to the public domain|waived all copyright and related or neighboring rights to} [under] [{1..6}] {cc0|creative commons zero} [1 0] [universal]"),
]

#: Mandatory words at which the score is a half.
HALF = 8

#: What belongs to a word (letters, digits and all beyond ASCII, A-Z lower-cased); the rest parts words.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8: bytes beyond ASCII are those of characters beyond ASCII."""
    return text.translate(LETTERS).split()


def parsed(markup: str) -> list[tuple]:
    """A template as a sequence of ("word", w), ("optional", sequence), ("any", m, n) and ("choice", [sequence, ...])."""
    stack: list[list] = [[]]
    for token in re.findall(r"\{[^}]*\}|[\[\]]|[^\s\[\]{}]+", markup):
        if token == "[":
            stack.append([])
        elif token == "]":
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif token[0] != "{":
            stack[-1].append(("word", token))
        elif found := re.fullmatch(r"\{(\d+)\.\.(\d+)\}", token):
            stack[-1].append(("any", int(found[1]), int(found[2])))
        else:
            stack[-1].append(("choice", [parsed(part) for part in token[1:-1].split("|")]))
    if len(stack) != 1:
        raise ValueError(f"a region of the template is not closed: {markup[:60]}")
    return stack[0]


def mandatory(sequence: list[tuple]) -> int:
    """Words that any accepted run has: those outside of optional and replaceable regions, and of the shortest choice."""
    return sum(1 if n[0] == "word" else min(map(mandatory, n[1])) if n[0] == "choice" else 0 for n in sequence)


@dataclass
class Automaton:
    """States with edges by word, by any word, and without one; state 0 is the start, ``end`` accepts."""

    label: str
    words: list[dict[bytes, set[int]]] = field(default_factory=list)
    any: list[set[int]] = field(default_factory=list)
    free: list[set[int]] = field(default_factory=list)
    end: int = 0
    mandatory: int = 0

    @classmethod
    def of(cls, label: str, markup: str) -> Automaton:
        out, sequence = cls(label), parsed(markup)
        out.end = out.add(sequence, out.state())
        out.mandatory = mandatory(sequence)
        reached = [out.closure({s}) for s in range(len(out.free))]
        if out.end in reached[0] or any(out.any[s] for s in reached[0]):
            raise ValueError("a template begins with a word")
        out.free = reached
        return out

    def state(self) -> int:
        self.words.append({})
        self.any.append(set())
        self.free.append(set())
        return len(self.free) - 1

    def add(self, sequence: list[tuple], at: int) -> int:
        """Adds the states of a sequence that begins at a state; returns the state it leads to."""
        for kind, *what in sequence:
            if kind == "word":
                new = self.state()
                self.words[at].setdefault(what[0].encode(), set()).add(new)
            elif kind == "any":
                new, here = self.state(), at
                for k in range(what[1] + 1):
                    if k >= what[0]:
                        self.free[here].add(new)
                    if k < what[1]:
                        there = self.state()
                        self.any[here].add(there)
                        here = there
            else:
                ends = [self.add(part, at) for part in (what[0] if kind == "choice" else [what[0]])]
                new = self.state()
                for end in ends + ([at] if kind == "optional" else []):
                    self.free[end].add(new)
            at = new
        return at

    def closure(self, states: set[int]) -> set[int]:
        """The states and all that free edges lead to."""
        out, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()] - out:
                out.add(s)
                todo.append(s)
        return out

    def step(self, states: set[int], word: bytes) -> set[int]:
        out: set[int] = set()
        for s in states:
            for t in self.words[s].get(word, ()):
                out |= self.free[t]
            for t in self.any[s]:
                out |= self.free[t]
        return out

    def firsts(self) -> set[tuple[bytes, bytes | None]]:
        """First two words of runs; None for any second word, or none."""
        out = set()
        for w in {w for s in self.free[0] for w in self.words[s]}:
            after = self.step(self.free[0], w)
            loose = self.end in after or any(self.any[s] for s in after)
            out |= {(w, None)} if loose else {(w, v) for s in after for v in self.words[s]}
        return out

    def run(self, words: list[bytes], at: int) -> int:
        """The end of the longest accepted run from a place, or -1."""
        states, found = self.free[0], -1
        while states and at < len(words):
            states = self.step(states, words[at])
            at += 1
            if self.end in states:
                found = at
        return found


class Scanner:
    """All templates and phrases, by their first words."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        self.phrases: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for phrase, label in phrases.items():
            words = phrase.encode().split()
            self.phrases.setdefault(words[0], []).append((words, label))
        self.starts: dict[bytes, list[tuple[bytes | None, Automaton]]] = {}
        for label, markup in templates:
            automaton = Automaton.of(label, markup)
            for first, second in sorted(automaton.firsts(), key=repr):
                self.starts.setdefault(first, []).append((second, automaton))
        self.first = frozenset(self.phrases) | frozenset(self.starts)

    def base_places(self, words: list[bytes], places: list[int]) -> list[tuple[int, int, str]]:
        """(start, words, label) of every place of a phrase."""
        return [(i, len(phrase), label) for i in places for phrase, label in self.phrases.get(words[i], ()) if words[i : i + len(phrase)] == phrase]

    def regions(self, words: list[bytes], places: list[int]) -> list[tuple[int, int, str, int]]:
        """(start, end, label, mandatory words) of accepted runs: of each template the first, and on from its end."""
        out, free_from = [], {}
        for i in places:
            follows = words[i + 1] if i + 1 < len(words) else None
            for second, automaton in self.starts.get(words[i], ()):
                if second in (None, follows) and i >= free_from.get(id(automaton), 0):
                    end = automaton.run(words, i)
                    if end >= 0:
                        out.append((i, end, automaton.label, automaton.mandatory))
                        free_from[id(automaton)] = end
        return out


def score(found: int) -> float:
    return found / (found + HALF)


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, regions array<struct<label:string,first:bigint,last:bigint,mandatory:int>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """For each document the places of base phrases, the labels, the score, and ``regions``: what templates accepted, by first and last word."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1).cast(pa.binary()):
                words = words_of(text.as_py() or b"")
                first = scanner.first
                places = [i for i, w in enumerate(words) if w in first]
                base, regions = scanner.base_places(words, places), scanner.regions(words, places)
                starts, own = [b[0] for b in base], sorted({b[2] for b in base})
                most = max([b[1] for b in base] + [r[3] for r in regions], default=0)
                spans = [{"label": r[2], "first": r[0], "last": r[1] - 1, "mandatory": r[3]} for r in regions]
                out.append((len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(own), ",".join(sorted({*own, *(r[2] for r in regions)})), score(most), spans))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("mandatory", pa.int32())]))]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "regions"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], ["doc_id", *names])

    return rows.mapInArrow(run, RESULT)


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("regions")


def pattern(sequence: list[tuple]) -> str:
    """A template as a regular expression over words that end in a space."""
    out = ""
    for kind, *what in sequence:
        if kind == "word":
            out += what[0] + " "
        elif kind == "any":
            out += "(?:[^ ]+ ){%d,%d}" % tuple(what)
        elif kind == "optional":
            out += f"(?:{pattern(what[0])})?"
        else:
            out += "(?:" + "|".join(map(pattern, what[0])) + ")"
    return out


def _sql() -> str:
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    labels = [f"CASE WHEN regexp_matches(line, ' {pattern(parsed(m))}') THEN struct_pack(l := '{label}', m := {mandatory(parsed(m))}) END" for label, m in TEMPLATES]
    return rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT *, string_split(phrase, ' ') AS q FROM (VALUES {phrases}) v(phrase, label, k)),
s AS (SELECT rid, label, k, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i : i + k - 1] = q)) - 1 AS i FROM w, p),
b AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS own, max(k) AS k FROM s GROUP BY rid),
f AS (SELECT rid, list_filter([{", ".join(labels)}], lambda x: x IS NOT NULL) AS found FROM (SELECT rid, ' ' || array_to_string(w, ' ') || ' ' AS line FROM w)),
m AS (SELECT w.*, b.*, coalesce(own, []) AS mine, found, greatest(coalesce(k, 0), coalesce(list_max(list_transform(found, lambda x: x.m)), 0)) AS most FROM w LEFT JOIN b ON w.rid = b.rid JOIN f ON w.rid = f.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(mine), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(mine, list_transform(found, lambda x: x.l)))), ',') AS labels, most / (most + {HALF}) AS score FROM m
"""


OP13_SQL = _sql()
