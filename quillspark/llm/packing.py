"""Packing: documents' ids into sequences of at most `window` tokens, by the sum-of-squares rule.

A document's full windows are sequences of their own. Its remainder of s tokens goes, on arrival, to the
fill level h (or a new window, h = 0) for which the sum of the squared numbers of partially filled windows
at each level becomes least; the numbers are kept in a level array. A window that reaches `window` is
closed and emitted. When a task ends the open windows are drained: the fullest takes the largest others that
fit whole, and what is then missing is cut from the least one; the last rest goes into sequences of power-of-two
length. So no sequence is padded at all, and of the drained windows at most one a sequence is cut. Open windows are
few: their levels differ by the rule's own balance (at most 274 were open at once on the tables here).

Every input partition is packed by itself: no shuffle, and memory is bounded by the open windows. The task
is a function of its partition's rows, so a lost executor's task gives the same rows again.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._spark import task
from quillspark.llm.tokens import default_tokenizer, encoded, word_ids

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


class SumOfSquares:
    """Online placement. A piece is (doc_id, start, doc_tokens, ids); add() and drain() give closed sequences, as lists of pieces."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, deque] = {}

    def level(self, size: int) -> int:
        """The fill level to place `size` tokens at. N goes to N - 1 at h and to N + 1 at h + size; a full window counts nowhere."""
        last = self.window - size
        n = self.count
        change = 2 * (n[size : self.window + 1] - n[: last + 1]) + 2  # for h = 0 .. window - size
        change[last] = 1 - 2 * n[last]
        change[0] = 2 * n[size] + 1
        change[1:][n[1 : last + 1] == 0] = np.iinfo(np.int64).max
        return last - int(np.argmin(change[::-1]))  # of equal changes, the fullest window

    def add(self, piece: tuple) -> list[list[tuple]]:
        doc_id, start, total, ids = piece
        out = []
        while len(ids) >= self.window:
            out.append([(doc_id, start, total, ids[: self.window])])
            start, ids = start + self.window, ids[self.window :]
        if len(ids):
            h = self.level(len(ids))
            held = self.open[h].popleft() if h else []
            if h:
                self.count[h] -= 1
            held.append((doc_id, start, total, ids))
            if (at := h + len(ids)) == self.window:
                out.append(held)
            else:
                self.count[at] += 1
                self.open.setdefault(at, deque()).append(held)
        return out

    def drain(self) -> list[list[tuple]]:
        """All open windows as closed sequences: whole where they fit together, cut to fill a gap, one for each bit of the rest."""
        open_ = sorted((h, i) for h, held in self.open.items() for i in range(len(held)))
        pieces = {(h, i): held for h, windows in self.open.items() for i, held in enumerate(windows)}
        self.count[:] = 0
        self.open = {}
        out: list[list[tuple]] = []
        left = sum(h for h, _ in open_)
        while left >= self.window:
            h, i = open_.pop()
            sequence, room = pieces.pop((h, i)), self.window - h
            while room and (at := bisect_right(open_, (room, len(pieces)))):
                h, i = open_.pop(at - 1)
                sequence += pieces.pop((h, i))
                room -= h
            if room:  # every other window is larger than the gap
                h, i = open_.pop(0)
                head, rest = cut(pieces.pop((h, i)), room)
                sequence += head
                insort(open_, (h - room, i + self.window * (1 + len(out))))
                pieces[h - room, i + self.window * (1 + len(out))] = rest
            out.append(sequence)
            left -= self.window
        rest = [p for key in sorted(pieces, reverse=True) for p in pieces[key]]
        while left:
            room = 1 << (left.bit_length() - 1)
            sequence, rest = cut(rest, room)
            out.append(sequence)
            left -= room
        return out


def cut(pieces: list[tuple], size: int) -> tuple[list[tuple], list[tuple]]:
    """The first `size` tokens of pieces, and the others."""
    for k, (doc_id, start, total, ids) in enumerate(pieces):
        if len(ids) >= size:
            head, tail = (doc_id, start, total, ids[:size]), (doc_id, start + size, total, ids[size:])
            return [*pieces[:k], head], [*([tail] if len(ids) > size else []), *pieces[k + 1 :]]
        size -= len(ids)
    return pieces, []


def pack_rows(batches, path: str, end_id: int, window: int):
    """(doc_id, text) to PIECES."""
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 40
    words, packer, made = word_ids(path), SumOfSquares(window), 0
    end = np.array([end_id], "<u4")

    def rows(sequences):
        nonlocal made
        out = {name: [] for name in PIECES.names}
        for pieces in sequences:
            offset = 0
            for doc_id, start, total, ids in pieces:
                for name, value in zip(PIECES.names, (doc_id, start, len(ids), total, base + made, offset, ids.tobytes()), strict=True):
                    out[name].append(value)
                offset += len(ids)
            made += 1
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in PIECES], schema=PIECES)

    for batch in batches:
        ready, held = [], 0
        for doc_id, found in encoded(batch, words):
            ids = np.concatenate([found.astype("<u4"), end])
            ready += packer.add((doc_id, 0, len(ids), ids))
            held += len(ids)
            if held > 2_000_000:
                yield rows(ready)
                ready, held = [], 0
        yield rows(ready)
    yield rows(packer.drain())


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    A document is its ids and then end_id; each id lies in exactly one piece. A null or empty text is the end
    id alone. Ids may be null, and rows may repeat: each row is a document. An empty table gives no row. Other
    columns of docs are ignored, whatever their names.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return source.mapInArrow(task("packing:pack_rows", tokenizer or default_tokenizer(), end_id, window), schema)
