"""Periodic runs of words: stretches in which the same words come again and again, found with a suffix automaton.

A run is a stretch with smallest period q and at least max(least, times * q) words that no neighbouring word extends.
Words that are in no repeated window can be in no run, so hashed windows cut a text to stretches first (`window` says how
wide a window may be). Each stretch gets a suffix automaton. Its states are taken from long to short; a state's end
positions are an ordered set, into which the sets of the states above it are merged, small to large. Where two
neighbours of a merged set are no farther apart than the state is long, and no state above had both, they seed a square:
their distance is a smallest period, and the state's length says where the run begins. The run is then extended to the right.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._spark import task
from quillspark.llm.suffixes import covered

#: Words that are worked on together, or one text.
WORDS = 300_000
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
FOUND_COLUMNS = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def window(least: int, times: int) -> int:
    """The widest window of which every one inside a run comes again one period before or after it, inside the run.

    With n words and period q each window of w words does so if n >= 2 * q + w - 1, and n is max(least, times * q) at least.
    The end positions one period apart then share w words or more, too.
    """
    return max(1, min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 1)))


def repeated_stretches(words: list[bytes], stops: np.ndarray, width: int) -> list[tuple[int, int]]:
    """[first, last) of the stretches that windows of `width` words cover that come twice or more in their text; stops are the texts' ends.

    Windows are compared by a hash: where two collide a stretch is too long, which costs time only.
    """
    n = len(words)
    if n < width:
        return []
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    text = np.repeat(np.arange(len(stops)), np.diff(stops, prepend=0))
    key = text[: n - width + 1].astype(np.uint64)
    for j in range(width):
        key = key * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n - width + 1 + j]
    whole = np.flatnonzero(text[: n - width + 1] == text[width - 1 :])
    order = whole[np.argsort(key[whole])]
    same = key[order[1:]] == key[order[:-1]]
    length = np.zeros(n, np.int64)
    length[order[1:][same]] = length[order[:-1][same]] = width
    inside = covered(length, 1)
    begins = inside & np.r_[True, ~inside[:-1] | (text[1:] != text[:-1])]
    ends = inside & np.r_[~inside[1:] | (text[1:] != text[:-1]), True]
    return list(zip(np.flatnonzero(begins).tolist(), (np.flatnonzero(ends) + 1).tolist(), strict=True))


class Automaton:
    """The suffix automaton of a list of words: each state's length and suffix link, and the state of each prefix.

    Most states have one transition, which two lists hold; only the others have a dict.
    """

    def __init__(self, words: list[bytes]):
        self.length, self.link, self.prefix = [0], [-1], []
        self.word, self.to, self.more = [None], [0], {}
        last = 0
        for w in words:
            last = self.extend(last, w)
            self.prefix.append(last)

    def go(self, state: int, w: bytes) -> int:
        """The state after w, or 0: no transition leads to the first state."""
        if self.word[state] == w:
            return self.to[state]
        more = self.more.get(state)
        return more.get(w, 0) if more else 0

    def lead(self, state: int, w: bytes, to: int) -> None:
        if self.word[state] is None or self.word[state] == w:
            self.word[state], self.to[state] = w, to
        else:
            self.more.setdefault(state, {})[w] = to

    def state(self, length: int, link: int, word: bytes | None, to: int) -> int:
        for column, value in ((self.length, length), (self.link, link), (self.word, word), (self.to, to)):
            column.append(value)
        return len(self.length) - 1

    def extend(self, last: int, w: bytes) -> int:
        new, p, q = self.state(self.length[last] + 1, 0, None, 0), last, 0
        while p >= 0 and not (q := self.go(p, w)):
            self.lead(p, w, new)
            p = self.link[p]
        if p < 0:
            return new
        if self.length[q] == self.length[p] + 1:
            self.link[new] = q
            return new
        copy = self.state(self.length[p] + 1, self.link[q], self.word[q], self.to[q])
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        while p >= 0 and self.go(p, w) == q:
            self.lead(p, w, copy)
            p = self.link[p]
        self.link[q] = self.link[new] = copy
        return new


class Places:
    """An ordered set of positions, in sorted blocks of at most `MOST`: an insertion moves no more than a block."""

    MOST = 1024

    def __init__(self, place: int):
        self.blocks, self.firsts, self.size = [[place]], [place], 1

    def around(self, place: int) -> tuple[int, int]:
        """The block that place belongs to, and how many of its positions are not after place."""
        k = max(0, bisect_right(self.firsts, place) - 1)
        return k, bisect_right(self.blocks[k], place)

    def after(self, place: int) -> int | None:
        k, i = self.around(place)
        if i < len(self.blocks[k]):
            return self.blocks[k][i]
        return self.firsts[k + 1] if k + 1 < len(self.blocks) else None

    def add(self, place: int) -> tuple[int | None, int | None]:
        """Adds a new position; its neighbours."""
        k, i = self.around(place)
        block = self.blocks[k]
        before = block[i - 1] if i else None
        after = block[i] if i < len(block) else self.firsts[k + 1] if k + 1 < len(self.blocks) else None
        block.insert(i, place)
        self.size += 1
        if not i:
            self.firsts[k] = place
        if len(block) > self.MOST:
            half = len(block) // 2
            self.blocks[k : k + 1] = [block[:half], block[half:]]
            self.firsts.insert(k + 1, block[half])
        return before, after

    def __iter__(self):
        return chain.from_iterable(self.blocks)


def runs_of(words: list[bytes], least: int, times: int, width: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a stretch. States of fewer than `width` words are left out: no run needs them."""
    made = Automaton(words)
    length, link = made.length, made.link
    ends: dict[int, Places] = {state: Places(i) for i, state in enumerate(made.prefix)}
    seeds: dict[int, list[tuple[int, int]]] = {}
    found: dict[tuple[int, int], int] = {}
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        if length[state] < width:
            break
        own = ends.pop(state)
        for a, b in seeds.pop(state, ()):
            # Between the two a later merge may have put a third: then their distance is no smallest period.
            start, period = a - length[state] + 1, b - a
            if (start, period) in found or own.after(a) != b:
                continue
            stop = b + 1
            while stop < len(words) and words[stop] == words[stop - period]:
                stop += 1
            found[start, period] = stop - start
        up = link[state]
        size = length[up]
        if size < width:
            continue
        other = ends.get(up)
        if other is None:
            ends[up] = own
            continue
        if other.size < own.size:
            own, other = other, own
            ends[up] = other
        last = None
        for place in own:
            before, after = other.add(place)
            # Two of the same set were neighbours there already.
            if before is not None and before != last and place - before <= size:
                seeds.setdefault(up, []).append((before, place))
            if after is not None and after - place <= size:
                seeds.setdefault(up, []).append((place, after))
            last = place
    return sorted((s, n, q) for (s, q), n in found.items() if n >= max(least, times * q))


def judged(texts: list[tuple[int | None, list[bytes]]], least: int, times: int) -> pa.RecordBatch:
    words = [w for _, ws in texts for w in ws]
    stops = np.cumsum([len(ws) for _, ws in texts])
    width = window(least, times)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for first, last in repeated_stretches(words, stops, width):
        if last - first < least:
            continue
        i = int(np.searchsorted(stops, first, "right"))
        offset = first - (int(stops[i - 1]) if i else 0)
        runs[i] += [(offset + s, n, q) for s, n, q in runs_of(words[first:last], least, times, width)]
    collapsed = []
    for (_, ws), own in zip(texts, runs, strict=True):
        if own:
            keep = np.ones(len(ws), bool)
            for s, n, q in own:
                keep[s + q : s + n] = False
            ws = [ws[i] for i in np.flatnonzero(keep)]
        collapsed.append(b" ".join(ws))
    rows = [[{"start": s, "length": n, "period": q} for s, n, q in sorted(own, key=lambda r: (r[0], r[2]))] for own in runs]
    columns = [[i for i, _ in texts], [len(ws) for _, ws in texts], rows]
    return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=False)), pa.array(collapsed, pa.binary()).cast(pa.string())], schema=FOUND)


def run_rows(batches, least: int, times: int):
    """(id, text) to FOUND."""
    texts, held = [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = (text or "").encode().split()
            if texts and held + len(words) > WORDS:
                yield judged(texts, least, times)
                texts, held = [], 0
            texts.append((i, words))
            held += len(words)
    if texts:
        yield judged(texts, least, times)


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """One row per row of docs: id, n_words, runs (start, length and period in words, by start, then period), collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. collapsed is the text without the words that any run holds after
    its first period, joined by single spaces; of a text without runs that is all its words.

    A null or empty text has no word, no run and an empty collapsed text. Null ids are returned as they are, repeated
    rows are judged each, and an empty table gives an empty one. Other columns of docs are ignored, whatever their names.
    A text is worked on whole in one task: about 300 bytes a word of its stretches that repeat. `times` is at least 2.
    """
    if times < 2:
        raise ValueError("a run is two periods at least")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(task("periodic:run_rows", least, times), FOUND_COLUMNS)
