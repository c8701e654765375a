"""License scan: exact set-similarity join of text blocks with license templates.

Blocks are runs of ``BLOCK`` words that start every ``BLOCK / 2`` words, so a template of at most half a block lies
whole in one of them.  A block meets a template when it holds at least ``threshold`` of the template's distinct words,
among them all words that name a license (``NAMES``).  A template of fewer than ``SHORT`` words is met only by all of
them, standing in a run of twice as many words: one word more or less makes another license of it.

Words are ordered by their frequency in the whole corpus (ties by the word), rarest first.  A block that meets
template T holds at least ceil(threshold * |T|) of its words, so it holds one of the |T| - ceil(threshold * |T|) + 1
rarest: the prefix.  Prefix words are joined with the blocks; a block with fewer words than needed is dropped
(length filter), as is one that cannot reach the threshold with the words behind its first prefix match (positional
filter); what is left is counted in full.

At scale: one pass counts the template words (a bounded vocabulary, summed per task, a few hundred rows in all), a
second finds base phrases and blocks.  Both are map-only; the templates are the small, fixed side of the join.

Null or empty text: no words, no labels, score 0.  Null ``doc_id`` and repeated rows: scanned row by row.  Empty
table: no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_words, ready

BLOCK, THRESHOLD, SHORT = 64, 0.8, 10

#: Base phrases and labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates: label and the wording that gives the license away (fixed values, natural order).
TEMPLATES = {
    "apache": ("Licensed under the Apache License, Version 2.0",
               "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met",),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License",),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0",),
    "gpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License",
            "This work is licensed under the GNU General Public License, version 3"),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
            "Released under the MIT License"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License",),
}

#: Words that tell licenses apart; a template that holds one is not met without it (fixed values).
NAMES = frozenset(b"apache attribution by cc commons creative gnu mit mozilla nc".split())


class Template(NamedTuple):
    label: str
    ordered: tuple[bytes, ...]  # distinct words, rarest in the corpus first
    need: int  # words a block must hold

    @property
    def names(self) -> frozenset[bytes]:
        return NAMES.intersection(self.ordered)

    @property
    def span(self) -> int | None:
        """Words among which all words of a short template must stand."""
        return 2 * len(self.ordered) if len(self.ordered) < SHORT else None

    @property
    def prefix(self) -> tuple[bytes, ...]:
        return self.ordered[:len(self.ordered) - self.need + 1]


def word_sets(templates: dict[str, tuple[str, ...]]) -> list[tuple[str, frozenset[bytes]]]:
    sets = [(label, frozenset(fold_words(t))) for label, texts in templates.items() for t in texts]
    if any(len(fold_words(t)) > BLOCK // 2 for texts in templates.values() for t in texts):
        raise ValueError("a template is longer than half a block")
    return sets


def frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each template word occurs: at most as many rows as template words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(vocabulary.intersection(fold_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                         names=["word", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def ordered_templates(sets: list[tuple[str, frozenset[bytes]]], seen: dict[bytes, int], threshold: float) -> list[Template]:
    out = []
    for label, words in sets:
        need = len(words) if len(words) < SHORT else -(-round(threshold * 1000) * len(words) // 1000)
        out.append(Template(label, tuple(sorted(words, key=lambda w: (seen.get(w, 0), w))), need))
    return out


class Matcher:
    """Finds the templates that each block of a text meets."""

    def __init__(self, templates: list[Template]):
        self.index: dict[bytes, list[tuple[Template, int]]] = {}
        for t in templates:
            for k, w in enumerate(t.prefix):
                self.index.setdefault(w, []).append((t, k))
        self.keys = frozenset(self.index)

    def matches(self, words: list[bytes]) -> dict[tuple[str, tuple[bytes, ...]], float]:
        """(label, template) with the highest containment in any block."""
        best: dict[tuple[str, tuple[bytes, ...]], float] = {}
        if self.keys.isdisjoint(words):
            return best
        for start in range(0, max(1, len(words) - BLOCK // 2), BLOCK // 2):
            block = frozenset(words[start:start + BLOCK])
            first: dict[tuple[str, tuple[bytes, ...]], tuple[Template, int]] = {}
            for w in self.keys & block:
                for t, k in self.index[w]:
                    old = first.get((t.label, t.ordered))
                    if old is None or k < old[1]:
                        first[t.label, t.ordered] = t, k
            for key, (t, k) in first.items():
                if len(block) < t.need or len(t.ordered) - k < t.need:  # length and positional filters
                    continue
                common = len(block.intersection(t.ordered))
                if common >= t.need and t.names <= block and together(words[start:start + BLOCK], t):
                    best[key] = max(best.get(key, 0.0), common / len(t.ordered))
        return best


def together(words: list[bytes], t: Template) -> bool:
    """Do all words of a short template stand in one run of ``span`` words?"""
    if t.span is None:
        return True
    return any(frozenset(words[i:i + t.span]).issuperset(t.ordered) for i in range(max(1, len(words) - t.span + 1)))


def phrase_places(words: list[bytes], phrases: dict[bytes, str]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase stands."""
    joined, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases.items():
        find = b" " + phrase + b" "
        at, seen, before = joined.find(find), 0, 0
        while at >= 0:
            before, seen = before + joined.count(b" ", seen, at), at  # words before it, counted on from the last place
            out.append((before, label))
            at = joined.find(find, at + 1)
    return out


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, places, labels and score of every document; ``matched`` maps each template label to its containment."""
    ready(docs.sparkSession)
    sets = word_sets(TEMPLATES if templates is None else templates)
    seen = frequencies(docs, frozenset().union(*[w for _, w in sets]))
    ordered = ordered_templates(sets, seen, threshold)
    phrases = {b" ".join(fold_words(p)): label for p, label in PHRASES.items()}
    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
              "labels string, score double, matched map<string,double>")
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.map_(pa.string(), pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(ordered)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = fold_words(text)
                places = phrase_places(words, phrases)
                found: dict[str, float] = {}
                for (label, _), share in matcher.matches(words).items():
                    found[label] = max(found.get(label, 0.0), share)
                base, at = sorted({p[1] for p in places}), [p[0] for p in places]
                rows.append((doc, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(base),
                             ",".join(sorted({*base, *found})), 1.0 if base else max(found.values(), default=0.0),
                             sorted(found.items())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)],
                                                 names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
