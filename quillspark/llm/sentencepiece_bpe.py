"""SentencePiece BPE with seeded merge-dropout, and decoding.

The agenda holds candidate merges, best score first and leftmost among equals. A candidate that comes up is
skipped when the keyed hash of (seed, variant, text, span, middle) falls below the dropout, so a segmentation is
a function of its text and key alone. Where no piece of the vocabulary holds two characters side by side, nothing
can merge across them: texts are cut into words before spaces, and words are segmented apart and cached. The i-th word
of a document uses variant (offset of the document + i) mod `variants`, so a word comes out differently in different
places. The words of a batch that no cache holds are segmented together, one merge of every word a step.
A literal U+2581 is written as its three bytes: decoding gives the text back exactly.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._spark import RELEASE, task

UNITS = re.compile(r" *[^ ]+| +")


SHORT = 32
MASK = (1 << 64) - 1


def key_of(seed: int, variant: int, unit: str) -> int:
    return xxhash.xxh64_intdigest(f"{seed}:{variant}:{unit}")


def skipped(key: int, begin: int, middle: int, end: int, bound: int) -> bool:
    """Whether the merge of [begin, middle) and [middle, end) is dropped: a hash of 32 bits below the bound."""
    x = (key ^ (begin << 42 | middle << 21 | end)) * 0x9E3779B97F4A7C15 & MASK
    x ^= x >> 29
    return (x * 0xBF58476D1CE4E5B9 & MASK) >> 32 < bound


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, tuple[float, int]] = {}
        self.byte: dict[int, int] = {}
        self.piece: list[str] = []
        for i in range(model.vocab_size()):
            text = model.id_to_piece(i).replace("▁", " ")
            if model.is_byte(i):
                b = int(text[3:5], 16)
                self.byte[b] = i
                self.piece.append(chr(b) if b < 128 else chr(0xDC00 + b))  # as surrogateescape has it
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.piece.append("")
            else:
                self.rank[text] = (-model.get_score(i), i)
                self.piece.append(text)
        self.score = {p: score for p, (score, _) in self.rank.items()}
        self.unknown = model.unk_id()
        self.cuts = not any(" " in p.lstrip(" ") for p in self.rank)
        self.lines = not any("\n" in p for p in self.rank)
        self.pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.dtype = np.dtype("<u2" if len(self.piece) < 1 << 16 else "<u4")

    def atoms(self, unit: str) -> list[str]:
        """unit, cut wherever no piece holds the two characters side by side."""
        pairs, out, first = self.pairs, [], 0
        for i in range(1, len(unit)):
            if unit[i - 1 : i + 1] not in pairs:
                out.append(unit[first:i])
                first = i
        out.append(unit[first:])
        return out

    def segment(self, unit: str, seed: int, variant: int, dropout: float) -> list[int]:
        """Ids of a text; a character outside the vocabulary becomes its UTF-8 bytes."""
        n, rank = len(unit), self.rank
        if n == 1 or not dropout and unit in rank and n < 3:
            found = rank.get(unit)
            return [found[1]] if found else [self.byte.get(x, self.unknown) for x in unit.encode()]
        bound = int(dropout * (1 << 32))
        key = key_of(seed, variant, unit) if bound else 0
        return self.segment_short(unit, key, bound) if n <= SHORT else self.segment_long(unit, key, bound)

    def segment_long(self, unit: str, key: int, bound: int) -> list[int]:
        """segment() with the agenda as a heap."""
        n, rank = len(unit), self.rank
        right = list(range(1, n + 1))  # the end of the symbol that begins here; 0 once merged into the one before
        begin = list(range(n))  # the begin of the symbol that ends at i + 1
        agenda = [(found[0], i, i + 1, i + 2) for i in range(n - 1) if (found := rank.get(unit[i : i + 2]))]
        heapq.heapify(agenda)
        while agenda:
            _, a, m, b = heapq.heappop(agenda)
            if right[a] != m or m >= n or right[m] != b:
                continue
            if bound and skipped(key, a, m, b, bound):
                continue
            right[a], right[m] = b, 0
            begin[b - 1] = a
            if a and (found := rank.get(unit[(p := begin[a - 1]) : b])):
                heapq.heappush(agenda, (found[0], p, a, b))
            if b < n and right[b] and (found := rank.get(unit[a : right[b]])):
                heapq.heappush(agenda, (found[0], a, b, right[b]))
        out, i = [], 0
        while i < n:
            j = right[i]
            if found := rank.get(unit[i:j]):
                out.append(found[1])
            else:
                out += [self.byte.get(x, self.unknown) for x in unit[i:j].encode()]
            i = j
        return out

    def segment_short(self, unit: str, key: int, bound: int) -> list[int]:
        """segment() with the agenda as a list of the scores of neighbours, which is faster for few characters."""
        score, none = self.score, float("inf")
        parts, starts = list(unit), list(range(len(unit)))
        agenda = [score.get(unit[i : i + 2], none) for i in range(len(unit) - 1)]
        while agenda and (best := min(agenda)) < none:
            i = agenda.index(best)
            if bound and skipped(key, starts[i], starts[i + 1], starts[i + 1] + len(parts[i + 1]), bound):
                agenda[i] = none
                continue
            part = parts[i] + parts[i + 1]
            parts[i] = part
            del parts[i + 1], starts[i + 1], agenda[i]
            if i:
                agenda[i - 1] = score.get(parts[i - 1] + part, none)
            if i < len(agenda):
                agenda[i] = score.get(part + parts[i + 1], none)
        rank, out = self.rank, []
        for part in parts:
            if found := rank.get(part):
                out.append(found[1])
            else:
                out += [self.byte.get(x, self.unknown) for x in part.encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: runs of bytes as UTF-8 (bad bytes as U+FFFD), without the first space, which encoding added."""
        text = "".join(map(self.piece.__getitem__, ids))
        if not text.isascii():
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class Merges:
    """The vocabulary as numbers. A symbol is a piece, or a character of one; a pair of symbols has the rank of what it merges to."""

    NONE = (1 << 31) - 1

    def __init__(self, words: Vocabulary):
        self.words = words
        characters = sorted({c for p in words.rank for c in p})
        names = {p: i for i, p in enumerate(dict.fromkeys([*characters, *words.rank]))}
        self.n = len(names)
        self.ids = np.array([words.rank[p][1] if p in words.rank else -1 for p in names], np.int64)
        self.characters = np.array([ord(c) for c in characters], np.uint32)  # symbol i is character i
        order = {x: i for i, x in enumerate(sorted({x for x, _ in words.rank.values()}))}
        made = [(names[p[:i]] * self.n + names[p[i:]], order[x], names[p]) for p, (x, _) in words.rank.items() for i in range(1, len(p)) if p[:i] in names and p[i:] in names]
        self.pairs, self.ranks, self.merged = map(np.ascontiguousarray, np.array(sorted(made), np.int64).reshape(-1, 3).T)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol) of what two symbols merge to; the rank is NONE for nothing."""
        key = np.where((left < 0) | (right < 0), -1, left * self.n + right)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], self.NONE), self.merged[at]

    def segment(self, units: list[str], keys: np.ndarray, bound: int, chunk: int = 8192) -> list[bytes]:
        """The ids of words of at most SHORT characters, as segment() gives them; similar lengths go together."""
        out = [b""] * len(units)
        order = sorted(range(len(units)), key=lambda i: len(units[i]))
        for first in range(0, len(order), chunk):
            own = order[first : first + chunk]
            for i, ids in zip(own, self.segment_chunk([units[i] for i in own], keys[own], bound), strict=True):
                out[i] = ids
        return out

    def segment_chunk(self, units: list[str], keys: np.ndarray, bound: int) -> list[bytes]:
        n, sizes = len(units), np.array(list(map(len, units)), np.int64)
        width = int(sizes.max())
        here = np.arange(width + 1) < sizes[:, None]
        codes = np.frombuffer("".join(units).encode("utf-32-le"), "<u4")
        at = np.minimum(np.searchsorted(self.characters, codes), len(self.characters) - 1)
        symbol = np.full((n, width + 1), -1, np.int64)
        symbol[here] = np.where(self.characters[at] == codes, at, -1)
        ends = np.tile(np.arange(1, width + 2), (n, 1))  # where the symbol that begins here ends
        before = np.tile(np.arange(-1, width), (n, 1))  # where the symbol before it begins
        agenda, makes = self.look(symbol[:, :-1], symbol[:, 1:])
        rows = np.arange(n)
        while True:
            each = agenda[rows]
            a = each.argmin(axis=1)  # the leftmost of the best
            left = each[np.arange(len(rows)), a] < self.NONE
            rows, a = rows[left], a[left]
            if not len(rows):
                break
            r, m = rows, ends[rows, a]
            b = ends[r, m]
            if bound:
                x = (keys[r] ^ (a << 42 | m << 21 | b).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
                skip = x >> np.uint64(32) < np.uint64(bound)
                agenda[r[skip], a[skip]] = self.NONE
                r, a, m, b = r[~skip], a[~skip], m[~skip], b[~skip]
            symbol[r, a] = makes[r, a]
            symbol[r, m] = -1
            ends[r, a], before[r, b] = b, a
            here[r, m] = False
            agenda[r, m] = self.NONE
            agenda[r, a], makes[r, a] = self.look(symbol[r, a], symbol[r, b])
            p = before[r, a]
            r, a, p = r[p >= 0], a[p >= 0], p[p >= 0]
            agenda[r, p], makes[r, p] = self.look(symbol[r, p], symbol[r, a])
        found = symbol[here]
        ids = np.where(found < 0, -1, self.ids[found])
        stop = np.cumsum(here.sum(axis=1)).tolist()
        odd = set(np.repeat(np.arange(n), here.sum(axis=1))[ids < 0].tolist())  # characters outside the vocabulary
        flat, step = ids.astype(self.words.dtype).tobytes(), self.words.dtype.itemsize
        out = [flat[x * step : y * step] for x, y in zip([0, *stop], stop, strict=False)]
        for i in odd:
            unit = units[i]
            ids = self.words.segment_short(unit, int(keys[i]), bound) if len(unit) > 1 else self.words.segment(unit, 0, 0, 0.0)
            out[i] = np.array(ids, self.words.dtype).tobytes()
        return out


class Units:
    """Words of one variant to the bytes of their ids, cached in two generations."""

    def __init__(self, merges: Merges, seed: int, variant: int, dropout: float, most: int):
        self.merges, self.of, self.most = merges, (seed, variant, dropout), most
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, units: set[str]) -> dict[str, bytes]:
        """A table that holds all of the given words."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        lacking = units.difference(self.new)
        known = lacking & self.old.keys()
        self.new.update(zip(known, map(self.old.__getitem__, known), strict=True))
        lacking -= known
        (seed, variant, dropout), words = self.of, self.merges.words
        short = [u for u in lacking if len(u) <= SHORT]
        prefix = f"{seed}:{variant}:"
        keys = np.array([xxhash.xxh64_intdigest(prefix + u) for u in short], np.uint64)
        self.new.update(zip(short, self.merges.segment(short, keys, int(dropout * (1 << 32))), strict=True))
        for unit in lacking:
            if len(unit) > SHORT:
                self.new[unit] = b"".join(np.array(words.segment(a, seed, variant, dropout), words.dtype).tobytes() for a in words.atoms(unit))
        return self.new


class Encoder:
    def __init__(self, path: str, seed: int, dropout: float, variants: int):
        self.vocabulary = vocabulary(path)
        self.seed, self.variants = seed, variants if dropout else 1
        merges = Merges(self.vocabulary)
        self.units = [Units(merges, seed, v, dropout, 200_000 // self.variants) for v in range(self.variants)]

    def words(self, text: str) -> list[str]:
        text = " " + text
        if not self.vocabulary.cuts:
            return [text]
        if "  " in text or text[-1] == " " or " \n" in text or not self.vocabulary.lines:
            return UNITS.findall(text)
        return [x if x[0] == "\n" else " " + x for x in text[1:].replace("\n", " \n").split(" ")]  # single spaces and line feeds

    def encode_many(self, texts: list[str | None], places: list) -> list[np.ndarray]:
        v = self.variants
        words = [self.words(t) if t else [] for t in texts]
        first = [xxhash.xxh64_intdigest(f"{self.seed}:{p}") % v for p in places]
        asked: list[set[str]] = [set() for _ in range(v)]
        for units, f in zip(words, first, strict=True):
            for i in range(min(v, len(units))):
                asked[(f + i) % v].update(units[i::v])
        tables = [u.learn(a) for u, a in zip(self.units, asked, strict=True)]
        out = []
        for units, f in zip(words, first, strict=True):
            parts: list[bytes] = [b""] * len(units)
            for i in range(min(v, len(units))):
                parts[i::v] = map(tables[(f + i) % v].__getitem__, units[i::v])
            out.append(np.frombuffer(b"".join(parts), self.vocabulary.dtype))
        return out

    def encode(self, text: str | None, place: object = None) -> np.ndarray:
        return self.encode_many([text], [place])[0]


_VOCABULARIES: dict[str, Vocabulary] = {}
_ENCODERS: dict[tuple, Encoder] = {}
RELEASE.append(_ENCODERS.clear)


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def encode_rows(batches, id_at: int, text_at: int, path: str, seed: int, dropout: float, variants: int):
    """Batches with a last column ids."""
    key = (path, seed, dropout, variants)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    encoder = _ENCODERS[key]
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            found = encoder.encode_many(part.column(text_at).to_pylist(), part.column(id_at).to_pylist())
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = np.concatenate(found).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, "ids"])


def decode_rows(batches, at: int, path: str, name: str):
    """Batches with a last column of the text of column `at`."""
    words = vocabulary(path)
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            column = part.column(at)
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            texts = [words.decode(flat[a:b].tolist()) if ok else None for a, b, ok in zip(ends[:-1], ends[1:], column.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, name])


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, seed: int = 1, dropout: float = 0.1, variants: int = 4) -> DataFrame:
    """doc_id, text and ids (array of int) of every whole text. dropout 0 gives the library's own segmentation.

    A null or empty text has no id. A null identifier is a key like any other; repeated rows come out alike.
    Other columns are ignored, whatever their names; an empty table gives no row.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([*source.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return source.mapInArrow(task("sentencepiece_bpe:encode_rows", 0, 1, model or default_model(), seed, dropout, variants), schema)


def decode(encoded: DataFrame, *, ids_col: str = "ids", out_col: str = "decoded", model: str | None = None) -> DataFrame:
    """encoded with the text of ids_col in out_col; null ids give null, no id the empty text."""
    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())])
    return encoded.mapInArrow(task("sentencepiece_bpe:decode_rows", encoded.columns.index(ids_col), model or default_model(), out_col), schema)
