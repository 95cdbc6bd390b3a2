"""Licence scan by template-markup matching.

A template is licence wording with mark-up: ``[[ ... ]]`` is optional (may
nest), ``<<n>>`` is a replaceable region of up to n words. Templates compile
into token automata (a set of states per position, no backtracking). A place in
a text is accepted when the automaton reaches its end, that is when all
mandatory wording stands there exactly, in order, word for word.

Words are maximal runs of digits, letters and non-ASCII characters of the text
with A-Z lower-cased. The base phrases are templates without mark-up whose
every place is counted.

Row-wise, no shuffle: words are counted with byte-class tables over a whole
slice of texts; only texts that hold an anchor word are tokenised.

Defined results: a null or empty text has no words, no labels (empty strings),
null first and last word and score 0. The score is the share of the text's
words inside accepted places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import added, append, text_slices, without

# The base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache",
                "general public license": "gpl"}

TEMPLATES = [
    ("mit", "[[released]] [[licensed]] under the [[terms of the]] mit license"),
    ("mit", "[[copyright [[c]] <<12>>]] permission is hereby granted free of charge to any person "
            "obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version <<2>>"),
    ("apache", "you may not use this [[file]] [[software]] except in compliance with the license"),
    ("gpl", "[[this work is]] licensed under the [[terms of the]] gnu [[lesser]] [[affero]] "
            "general public license [[version <<2>>]]"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu [[lesser]] "
            "general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under [[the]] [[creative commons]] cc by nc [[<<2>>]]"),
    ("bsd", "redistribution and use in source and binary forms with or without modification "
            "are permitted provided that the following conditions are met"),
]

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARK = re.compile(r"\[\[|\]\]|<<\d+>>|[^\s\[\]<>]+")
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(range(0x30)) + list(range(0x3A, 0x41)) + list(range(0x5B, 0x61))
         + list(range(0x7B, 0x80))] = False
ANY = None


@dataclass
class Automaton:
    """States 0..n; ``steps[s]`` holds (word or ANY, next state); ``empty[s]``
    the states reachable without a word; the last state accepts."""

    label: str
    steps: list[list[tuple[bytes | None, int]]] = field(default_factory=lambda: [[]])
    empty: list[set[int]] = field(default_factory=lambda: [set()])
    needed: set[bytes] = field(default_factory=set)

    def _new(self) -> int:
        self.steps.append([])
        self.empty.append(set())
        return len(self.steps) - 1

    def closure(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def finish(self) -> "Automaton":
        self.accept = len(self.steps) - 1
        self.initial = self.closure({0})
        self.first = {w for s in self.initial for w, _ in self.steps[s]}
        self.cache: dict[tuple[frozenset[int], bytes], frozenset[int]] = {}
        self.words = {w for step in self.steps for w, _ in step if w is not ANY}
        return self

    def step(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        key = (states, word if word in self.words else b"")
        got = self.cache.get(key)
        if got is None:
            got = self.cache[key] = self.closure(
                {t for s in states for w, t in self.steps[s] if w is ANY or w == word})
        return got

    def match(self, words: list[bytes], start: int) -> int | None:
        """End of the longest accepted run of words from ``start``, or None."""
        states, best = self.initial, None
        for at in range(start, len(words)):
            states = self.step(states, words[at])
            if not states:
                break
            if self.accept in states:
                best = at + 1
        return best


def compile_template(label: str, template: str) -> Automaton:
    """Mark-up to automaton. Inside ``[[a b]]`` all words form one optional
    region."""
    auto = Automaton(label)
    here, opened = 0, []
    for mark in _MARK.findall(template.lower()):
        if mark == "[[":
            opened.append(here)
        elif mark == "]]":
            if not opened:
                raise ValueError(f"unbalanced mark-up: {template!r}")
            nxt = auto._new()
            auto.empty[here].add(nxt)
            auto.empty[opened.pop()].add(nxt)
            here = nxt
        elif mark.startswith("<<"):
            end_from = [here]
            for _ in range(int(mark[2:-2])):
                nxt = auto._new()
                auto.steps[here].append((ANY, nxt))
                here = nxt
                end_from.append(here)
            nxt = auto._new()
            for s in end_from:
                auto.empty[s].add(nxt)
            here = nxt
        else:
            nxt = auto._new()
            word = mark.encode()
            if not opened:
                auto.needed.add(word)
            auto.steps[here].append((word, nxt))
            here = nxt
    if opened:
        raise ValueError(f"unbalanced mark-up: {template!r}")
    if not auto.needed:
        raise ValueError(f"a template needs mandatory wording: {template!r}")
    return auto.finish()


def compile_all(templates) -> list[Automaton]:
    return [compile_template(label, t) for label, t in templates]


def scan_words(words: list[bytes], automata: list[Automaton]) -> list[tuple[str, int, int]]:
    """Accepted places (label, start, end), leftmost first per template."""
    present = set(words)
    out = []
    for a in automata:
        if not a.needed <= present:
            continue
        at = 0
        for i, w in enumerate(words):
            if i < at or (w not in a.first and ANY not in a.first):
                continue
            end = a.match(words, i)
            if end is not None:
                out.append((a.label, i, end))
                at = end
    return out


def _word_counts(part: pa.RecordBatch, column: str) -> tuple[np.ndarray, list[bytes]]:
    """Words per text over the slice's bytes, and the lower-cased texts."""
    texts = [(t or "").encode() for t in part.column(part.schema.get_field_index(column)).to_pylist()]
    low = b"".join(texts).lower()
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - np.array([len(t) for t in texts])
    flags = _IS_WORD[np.frombuffer(low, np.uint8)]
    first = flags.copy()
    first[1:] &= ~flags[:-1]
    inner = begins[(begins < len(low))]
    first[inner] = flags[inner]       # a text's first byte starts anew
    upto = np.concatenate([[0], np.cumsum(first)])
    return upto[ends] - upto[begins], [low[b:e] for b, e in zip(begins, ends)]


def scan_licences(df: DataFrame, text_col: str = "text", base=None, templates=None) -> DataFrame:
    """``df`` with n_words, n_base, first_word, last_word, base_labels, labels,
    score and ``places`` (label, start, end of accepted template runs)."""
    base = BASE_PHRASES if base is None else base
    templates = TEMPLATES if templates is None else templates
    phrases = compile_all([(label, p) for p, label in base.items()])
    automata = compile_all(templates)
    # every match of a phrase or template holds one of its mandatory words
    anchors = sorted({max(sorted(a.needed), key=len) for a in [*phrases, *automata]})
    place = T.ArrayType(T.StructType([T.StructField("label", T.StringType()),
                                      T.StructField("start", T.LongType()),
                                      T.StructField("end", T.LongType())]))
    fields = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()),
              ("last_word", T.LongType()), ("base_labels", T.StringType()),
              ("labels", T.StringType()), ("score", T.DoubleType()), ("places", place)]
    rows = without(df, {n for n, _ in fields} - {text_col})

    def base_places(words):
        hits = []
        for a in phrases:
            if a.needed <= set(words):
                hits += [(a.label, i, end) for i, w in enumerate(words) if w in a.first
                         and (end := a.match(words, i)) is not None]
        return hits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text_col):
            counts, texts = _word_counts(part, text_col)
            out = []
            for n, text in zip(counts.tolist(), texts):
                if not any(a in text for a in anchors):
                    out.append((n, 0, None, None, "", "", 0.0, []))
                    continue
                words = WORD.findall(text)
                hits, more = base_places(words), scan_words(words, automata)
                covered = {i for _, b, e in hits + more for i in range(b, e)}
                starts = [b for _, b, _ in hits]
                out.append((n, len(hits), min(starts, default=None), max(starts, default=None),
                            ",".join(sorted({h[0] for h in hits})),
                            ",".join(sorted({h[0] for h in hits + more})),
                            len(covered) / n if n else 0.0,
                            [{"label": a, "start": b, "end": e} for a, b, e in more]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct(
                [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
            yield append(part, **{n: pa.array([o[k] for o in out], kind)
                                  for k, ((n, _), kind) in enumerate(zip(fields, kinds))})

    return rows.mapInArrow(run, added(rows, *fields))
