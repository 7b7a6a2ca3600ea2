"""License scans by template markup.

A template is wording with marks:

    [[ ... ]]      an optional region
    {{n}}          a replaceable region of up to n words
    other words    mandatory wording, which has to stand exactly

Each template is compiled into an automaton over tokens: a row of steps, where a
mandatory word moves on, an optional region may be passed over and a replaceable
one consumes up to its number of words. A text is accepted from some word
on if the automaton reaches its end. Only places of the mandatory words before a template's first
region are tried, which is exact, as every accepted run of words begins with them.

Words are maximal runs of ASCII digits, ASCII letters (lower-cased) and non-ASCII
characters. The base labels are three fixed phrases; the automata add theirs.

score is the share of a text's words that lie under some accepted wording, base
phrases included: 0 without any, 1 when all of the text is license wording.

Cases: a null or empty text has no words, no labels, null places and score 0;
overlapping places of a phrase all count; repeated rows give repeated results; an
empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, table

#: The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Wording of public license notices, with marks.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license [[ version ]] 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-sa": "creative commons attribution share alike [[ {{2}} international ]]",
    "cc-by": "licensed under [[ a ]] [[ the ]] creative commons attribution [[ {{2}} international ]]",
    "cc-short": "cc by [[ nc ]] [[ sa ]] [[ nd ]] {{1}} 0",
    "copyright": "copyright [[ c ]] {{6}} all rights reserved",
    "gpl-notice": "free software you can redistribute it and or modify it under the terms of the gnu [[ lesser ]] [[ affero ]] [[ library ]] general public license as published by the free software foundation",
    "gpl-short": "gnu [[ lesser ]] [[ affero ]] general public license [[ version {{1}} ]] [[ or later ]]",
    "isc": "permission to use copy modify and [[ or ]] distribute this software for any purpose with or without fee is hereby granted",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of {{8}} to deal in {{2}} without restriction",
    "mit-short": "released under the mit license",
    "mpl": "subject to the terms of the mozilla public license",
    "public-domain": "dedicated to the public domain",
    "spdx": "spdx license identifier {{1}}",
}

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Automaton:
    """A template as states 0..n: word[i] or gap[i] moves on from state i; skip[i] lists states reached without a word."""

    def __init__(self, markup: str):
        self.word: dict[int, str] = {}
        self.gap: dict[int, int] = {}
        self.skip: dict[int, list[int]] = {}
        state, opened = 0, []
        for token in markup.split():
            if token == "[[":
                opened.append(state)
            elif token == "]]":
                self.skip.setdefault(opened.pop(), []).append(state)
            elif found := re.fullmatch(r"\{\{(\d+)\}\}", token):
                self.gap[state] = int(found[1])
                state += 1
            else:
                self.word[state] = token
                state += 1
        lead = next((s for s in range(state) if s not in self.word or s in self.skip), state)
        if opened or not lead:
            raise ValueError(f"a template begins with a mandatory word and closes its regions: {markup}")
        self.end = state
        self.start = " ".join(self.word[s] for s in range(lead))

    def _reach(self, states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """With what is reached without a word. A state is a number and the words that its gap has taken."""
        todo, found = list(states), set(states)
        while todo:
            s, _ = todo.pop()
            nexts = [(t, 0) for t in self.skip.get(s, ())] + ([(s + 1, 0)] if s in self.gap else [])
            for n in nexts:
                if n not in found:
                    found.add(n)
                    todo.append(n)
        return found

    def match(self, words: list[str], at: int) -> int:
        """Length of the longest accepted run of words from `at`, 0 if there is none."""
        states, best, i = self._reach({(0, 0)}), 0, at
        while states:
            if any(s == self.end for s, _ in states):
                best = i - at
            if i == len(words):
                break
            moved = set()
            for s, used in states:
                if self.word.get(s) == words[i]:
                    moved.add((s + 1, 0))
                elif s in self.gap and used < self.gap[s]:
                    moved.add((s, used + 1))
            states, i = self._reach(moved), i + 1
        return best


def _places(joined: str, phrase: str) -> list[int]:
    """Word numbers at which the phrase stands in ' w0 w1 ... ' , overlapping ones too."""
    out, at, words, upto = [], joined.find(f" {phrase} "), 0, 0
    while at >= 0:
        words += joined.count(" ", upto, at)
        upto = at
        out.append(words)
        at = joined.find(f" {phrase} ", at + 1)
    return out


def scan(text: str, automata: dict[str, Automaton]) -> tuple:
    words = WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())
    joined = f" {' '.join(words)} "
    places, base, labels, covered = [], set(), set(), []
    for phrase, label in PHRASES.items():
        if found := _places(joined, phrase):
            places += found
            base.add(label)
            covered += [(p, p + phrase.count(" ") + 1) for p in found]
    for label, automaton in automata.items():
        for p in _places(joined, automaton.start):
            if n := automaton.match(words, p):
                labels.add(label)
                covered.append((p, p + n))
    under, reach = 0, 0
    for a, b in sorted(covered):
        under += max(0, b - max(a, reach))
        reach = max(reach, b)
    join = lambda x: ",".join(sorted(x))
    return (len(words), len(places), min(places, default=None), max(places, default=None), join(base), join(base | labels), under / len(words) if words else 0.0)


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]


def licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = {label: Automaton(markup) for label, markup in templates.items()}
        for batch in chunks(batches):
            rows = [scan(t or "", automata) for t in batch.column("text").to_pylist()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=[c.split()[0] for c in SCANNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCANNED)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license labels of every document."""
    return licenses(table(spark, sf_dir, "documents"))
