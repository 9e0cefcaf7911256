"""Licence notices: phrase counts, and template-markup matching by token automata.

A template is wording with marked regions: ``<<beginOptional>> ... <<endOptional>>`` may be
absent (and may nest), ``<<var;name=...;original=...;tokens=1-4>>`` stands for any words, as
many as ``tokens`` says. Each template compiles into an automaton over words; a place in a
text is accepted if the automaton consumes words from there, every mandatory word exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmeld.llm.text import ALNUM, pieces

PHRASES = {"cc-by": b"cc by", "gpl": b"general public license", "reserved": b"all rights reserved"}

# Wording of common notices, in template markup.
TEMPLATES = {
    "apache-2.0": "<<beginOptional>>Licensed under<<endOptional>> <<beginOptional>>the<<endOptional>> Apache License"
    " <<beginOptional>>Version<<endOptional>> 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
    " that the following conditions are met",
    "cc-by-4.0": "<<beginOptional>>Licensed under<<endOptional>> CC BY <<beginOptional>>license<<endOptional>> 4.0",
    "cc-by-nc-4.0": "<<beginOptional>>Licensed under<<endOptional>> CC BY-NC <<beginOptional>>license<<endOptional>> 4.0",
    "cc-by-sa-4.0": "<<beginOptional>>Licensed under<<endOptional>> CC BY-SA <<beginOptional>>license<<endOptional>> 4.0",
    "copyright": "Copyright <<beginOptional>>c<<endOptional>> <<var;name=holder;original=2001 Holder;tokens=1-8>>"
    " All rights reserved",
    "gpl-2.0": "GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>"
    " <<beginOptional>>either<<endOptional>> version 2",
    "gpl-3.0": "GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>"
    " <<beginOptional>>either<<endOptional>> version 3",
    "isc": "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any"
    " purpose with or without fee is hereby granted",
    "lgpl": "GNU <<var;name=kind;original=Lesser;tokens=1-1>> General Public License"
    " <<beginOptional>>version <<var;name=version;original=3;tokens=1-2>><<endOptional>>",
    "mit": "<<beginOptional>>Released under the<<endOptional>> MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of"
    " <<var;name=work;original=this software;tokens=2-4>> and associated documentation files",
    "mpl-2.0": "Mozilla Public License <<beginOptional>>v<<endOptional>> <<beginOptional>>version<<endOptional>> 2.0",
}

_MARK = re.compile(r"<<(.*?)>>", re.S)


def normal_words(text: bytes) -> bytes:
    """Words of a text, lower-cased and joined by one space, with a space at both ends."""
    return b" " + b" ".join(text.translate(ALNUM).split()) + b" "


@dataclass(frozen=True)
class Automaton:
    """States 0..n; ``words[s]`` lists (word or None for any, next state); ``skips[s]`` free moves."""

    words: tuple[tuple[tuple[bytes | None, int], ...], ...]
    skips: tuple[tuple[int, ...], ...]
    final: int
    anchor: bytes  # the longest run of mandatory words: a text without it is not accepted
    lead: int  # most words that an accepted place holds before its anchor

    def _free(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for target in self.skips[todo.pop()]:
                if target not in states:
                    states.add(target)
                    todo.append(target)
        return states

    def accept(self, words: list[bytes], start: int) -> int:
        """End (exclusive) of the longest accepted run of words from ``start``; -1 if there is none."""
        states, end = self._free({0}), -1
        for place in range(start, len(words)):
            word = words[place]
            states = self._free({t for s in states for want, t in self.words[s] if want is None or want == word})
            if not states:
                break
            if self.final in states:
                end = place + 1
        return end


def compile_template(template: str) -> Automaton:
    """Compile template markup; ValueError for unknown or unbalanced marks and templates without wording."""
    words: list[list[tuple[bytes | None, int]]] = [[]]
    skips: list[list[int]] = [[]]
    opened: list[int] = []
    runs: list[tuple[int, list[bytes]]] = [(0, [])]
    most = 0  # most words before the present state

    def state() -> int:
        words.append([])
        skips.append([])
        return len(words) - 1

    def step(word: bytes | None) -> None:
        at = len(words) - 1
        words[at].append((word, state()))

    for index, part in enumerate(_MARK.split(template)):
        if index % 2 == 0:
            for word in normal_words(part.encode("utf-8")).split():
                step(word)
                if not opened:
                    runs[-1][1].append(word)
                most += 1
            continue
        name, _, rest = part.partition(";")
        if name == "beginOptional":
            opened.append(len(words) - 1)
        elif name == "endOptional" and opened:
            begin, at = opened.pop(), len(words) - 1
            end = state()
            skips[at].append(end)
            skips[begin].append(end)
        elif name == "var":
            low, high = map(int, re.search(r"tokens=(\d+)-(\d+)", rest).groups())
            early = []
            for used in range(high):
                if used >= low:
                    early.append(len(words) - 1)
                step(None)
            end = state()
            skips[end - 1].append(end)
            for at in early:
                skips[at].append(end)
            most += high
        else:
            raise ValueError(f"unknown or unbalanced mark: {part}")
        if not opened:
            runs.append((most, []))
    if opened:
        raise ValueError("an optional region is not closed")
    lead, longest = max(runs, key=lambda run: len(run[1]))
    if not longest:
        raise ValueError("a template needs mandatory wording")
    return Automaton(
        tuple(map(tuple, words)), tuple(map(tuple, skips)), len(words) - 1, b" " + b" ".join(longest) + b" ", lead
    )


def compile_all(templates: dict[str, str]) -> dict[str, Automaton]:
    return {label: compile_template(text) for label, text in templates.items()}


def _places(normal: bytes, phrase: bytes) -> list[int]:
    """Indexes of the first words of all places where the phrase's words stand."""
    found, words, before = [], 0, 0
    at = normal.find(phrase)
    while at >= 0:
        words += normal.count(b" ", before, at)
        before = at
        found.append(words)
        at = normal.find(phrase, at + 1)
    return found


def scan_text(text: bytes, phrases: dict[str, bytes], automata: dict[str, Automaton]) -> tuple:
    """(n_words, phrase places as (label, word index), accepted places as (label, start, end))."""
    normal = normal_words(text)
    n_words = normal.count(b" ") - 1 if len(normal) > 2 else 0
    base = [(label, place) for label, phrase in phrases.items() for place in _places(normal, b" " + phrase + b" ")]
    accepted = []
    words: list[bytes] | None = None
    for label, automaton in automata.items():
        for anchor in _places(normal, automaton.anchor):
            words = normal.split() if words is None else words
            # Start as early as the optional wording allows.
            for start in range(max(0, anchor - automaton.lead), anchor + 1):
                end = automaton.accept(words, start)
                if end > anchor:
                    accepted.append((label, start, end))
                    break
    return n_words, base, accepted


def _covered(spans: list[tuple[int, int]]) -> int:
    total, reach = 0, 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


def _scan(phrases: dict[str, bytes], automata: dict[str, Automaton]):
    lengths = {label: len(phrase.split()) for label, phrase in phrases.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in pieces(batches):
            rows = []
            for text in texts:
                n_words, base, accepted = scan_text(text, phrases, automata)
                starts = [place for _, place in base]
                spans = [(place, place + lengths[label]) for label, place in base] + [(s, e) for _, s, e in accepted]
                base_labels = {label for label, _ in base}
                rows.append(
                    (
                        n_words,
                        len(base),
                        min(starts, default=None),
                        max(starts, default=None),
                        ",".join(sorted(base_labels)),
                        ",".join(sorted(base_labels | {label for label, _, _ in accepted})),
                        _covered(spans) / n_words if n_words else 0.0,
                        [{"label": label, "start": s, "end": e} for label, s, e in accepted],
                    )
                )
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _PLACES)
            arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *arrays], names=["doc_id", *_COLUMNS])

    return run


_PLACES = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")


def scan_licenses(docs: DataFrame, doc_id: Column, templates: dict[str, str] | None = None) -> DataFrame:
    """Phrase counts, labels and accepted places for every row.

    ``score`` is the share of a text's words inside phrases or accepted places. Null and empty
    texts have no words, no labels (empty strings), null word places and the score 0; repeated
    rows get equal results; long texts are scanned whole; an empty table gives an empty table.
    """
    automata = compile_all(TEMPLATES if templates is None else templates)
    chosen = docs.select(doc_id.alias("doc_id"), F.col("text").cast("binary").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(
        _scan(PHRASES, automata),
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string,"
        " labels string, score double, places array<struct<label: string, start: long, end: long>>",
    )
