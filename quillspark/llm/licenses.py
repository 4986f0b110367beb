"""License scans: an exact set-similarity join of text blocks with license templates, by containment.

Blocks and templates are sets of words, written in one global order: the words' document frequency in the whole corpus,
rarest first. A block holds a template if it has at least `share` of the template's words, `need` of them. Then the
first size - need + 1 words of the template and of the block share one (prefix filter); a block must have `need` words of
templates at all (length filter); and behind a shared word both must have enough words left (positional filter). What
passes is counted exactly, so the filters cost or save time only.

A block is a line for templates of a line's length, a window of the whole text for longer ones, which may be wrapped.
Longer lines are cut into windows, too; windows overlap by half, so that a notice of up to half a window lies in one whole.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._spark import task

# The phrases of the base rule, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Notices that the licenses' own texts ask for, and usual short forms of them.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl-3", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
)

SHARE, LINE, WINDOW = (9, 10), 32, 128
#: Words of all templates together: the list is a parameter that goes to every task (about 64 MB at most).
MOST_WORDS = 1_000_000

_LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: A-Z to a-z, what is no letter, digit or byte of another character to a space; line feeds stay.
PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _LETTERS or b == 10 else 32 for b in range(256))

PLACE = pa.struct([("word", pa.int64()), ("label", pa.string())])
MATCH = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("template", pa.int64()), ("label", pa.string()), ("containment", pa.float64())])
FOUND = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(PLACE)), ("matches", pa.list_(MATCH))])
FOUND_COLUMNS = "id long, n_words long, places array<struct<word: long, label: string>>, matches array<struct<first: long, last: long, template: long, label: string, containment: double>>"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(PLAIN).split()


def need(size: int, share: tuple[int, int]) -> int:
    """How many of a template's words a block must have: the share, rounded up, in whole numbers."""
    return -(-share[0] * size // share[1])


def starts(n: int, size: int) -> range:
    """Where the blocks of n words begin: one block, or windows of `size` words that overlap by half."""
    half = size // 2
    return range(0, max(1, -(-n // half) - 1) * half, half) if n else range(0)


@dataclass
class Templates:
    """Templates with their words as ranks in the global order, and the index of their prefixes."""

    labels: list[str]
    ranks: list[list[int]]
    needs: list[int]
    long: list[bool]
    rivals: list[set[int]]
    rank: dict[bytes, int]
    window: int

    @classmethod
    def build(cls, templates, counts: dict[bytes, int], share: tuple[int, int]) -> Templates:
        listed = [words_of(text) for _, text in templates]
        order = sorted({w for ws in listed for w in ws}, key=lambda w: (counts.get(w, 0), w))
        rank = {w: i for i, w in enumerate(order)}
        sets = [{rank[w] for w in ws} for ws in listed]
        rivals = [{j for j, other in enumerate(sets) if i != j and 2 * len(own & other) >= min(len(own), len(other))} for i, own in enumerate(sets)]
        window = max([WINDOW, *(2 * len(ws) for ws in listed)])
        return cls([t[0] for t in templates], [sorted(s) for s in sets], [need(len(s), share) for s in sets], [len(ws) > LINE // 2 for ws in listed], rivals, rank, window)

    def __post_init__(self):
        self.index: dict[tuple[bool, int], list[tuple[int, int]]] = {}
        for t, (ranks, least) in enumerate(zip(self.ranks, self.needs, strict=True)):
            for j, r in enumerate(ranks[: len(ranks) - least + 1]):
                self.index.setdefault((self.long[t], r), []).append((t, j))
        signal = {r for _, r in self.index}
        self.signals = {w for w, r in self.rank.items() if r in signal}

    def contained(self, words: list[bytes], long: bool) -> list[tuple[int, float]]:
        """(template, containment) of the templates that a block holds."""
        rank = self.rank
        block = sorted({rank[w] for w in words if w in rank})
        size, seen, pruned = len(block), Counter(), set()
        for i, r in enumerate(block):
            for t, j in self.index.get((long, r), ()):
                least = self.needs[t]
                if t in pruned or size < least or i > size - least:
                    continue
                if seen[t] + min(size - i, len(self.ranks[t]) - j) < least:
                    pruned.add(t)  # too few words are left in one of them
                    continue
                seen[t] += 1
        have = set(block)
        exact = ((t, sum(r in have for r in self.ranks[t])) for t in seen if t not in pruned)
        found = {t: n / len(self.ranks[t]) for t, n in exact if n >= self.needs[t]}
        better = lambda t: (found[t], len(self.ranks[t]), -t)
        return [(t, found[t]) for t in sorted(found) if not any(u in found and better(u) > better(t) for u in self.rivals[t])]


def count_rows(batches, vocabulary: set[bytes]):
    """(word, n): in how many texts of a batch each word of the templates is."""
    total = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                total.update(vocabulary.intersection(words_of(text)))
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


def places(words: list[bytes], phrases) -> list[tuple[int, str]]:
    """(word, label) of every place where a phrase's words stand."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases:
        sought = b" " + b" ".join(words_of(phrase)) + b" "
        at, word, last = joined.find(sought), 0, 0
        while at >= 0:
            word += joined.count(b" ", last, at)
            out.append((word, label))
            last, at = at, joined.find(sought, at + 1)
    return sorted(out)


def matches(raw: bytes, words: list[bytes], templates: Templates) -> list[tuple]:
    """(first, last, template, containment) of the blocks of a text that hold a template."""
    out = []
    if templates.signals.isdisjoint(words):
        return out
    if any(templates.long):
        for s in starts(len(words), templates.window):
            own = words[s : s + templates.window]
            if not templates.signals.isdisjoint(own):
                out += [(s, s + len(own) - 1, t, c) for t, c in templates.contained(own, True)]
    first = 0
    for line in raw.split(b"\n"):
        own = line.split()
        if not templates.signals.isdisjoint(own):
            for s in starts(len(own), LINE):
                part = own[s : s + LINE]
                out += [(first + s, first + s + len(part) - 1, t, c) for t, c in templates.contained(part, False)]
        first += len(own)
    return sorted(out)


def scan_rows(batches, templates: Templates, phrases):
    """(id, text) to FOUND."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 1000):
            rows = []
            ids, texts = (c.to_pylist() for c in batch.slice(begin, 1000).columns)
            for i, text in zip(ids, texts, strict=True):
                raw = (text or "").encode().translate(PLAIN)
                words = raw.split()
                found = [{"first": a, "last": b, "template": t, "label": templates.labels[t], "containment": c} for a, b, t, c in matches(raw, words, templates)]
                rows.append((i, len(words), [{"word": w, "label": x} for w, x in places(words, phrases)], found))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FOUND, strict=True)], schema=FOUND)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, share: tuple[int, int] = SHARE) -> DataFrame:
    """One row per row of docs: id, n_words, places (word, label) of the phrases, matches of the templates.

    Words are letters a-z (A-Z lower-cased), digits and all characters beyond ASCII, numbered from 0. A match has the first and
    last word of its block, the template (its place in the list), its label and its containment: the share of the template's
    distinct words that the block has, at least share[0] / share[1]. Templates of up to 16 words are sought in lines (in
    windows of 32 words where a line is longer), longer ones in windows of the text, of 128 words or twice the longest
    template. Of two templates that share half of the smaller one's words a block matches the better one only: the greater
    containment, then the larger, then the first. A template that overlapping windows hold is matched in each.

    A null or empty text has no word, place or match. Null ids are returned as they are, repeated rows are scanned each, an
    empty table gives an empty one, other columns are ignored. A template without words never matches.
    """
    templates = [(label, text) for label, text in templates if words_of(text)]
    vocabulary = {w for _, text in templates for w in words_of(text)}
    if sum(len(words_of(text)) for _, text in templates) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words: scan with parts of the list, one after the other")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = source.select("text").mapInArrow(task("licenses:count_rows", vocabulary), "word binary, n long")
    counts = {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    made = Templates.build(templates, counts, share)
    return source.mapInArrow(task("licenses:scan_rows", made, phrases), FOUND_COLUMNS)
