"""Word shingles of a text as sorted 64-bit hashes, and position-wise signatures of such sets. Runs on the workers."""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash

from quillspark.llm._spark import RELEASE

U = np.uint64
MASK = (1 << 64) - 1


class WordHashes(dict):
    """Word bytes to 64-bit hash; emptied when it holds `most` words."""

    most = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


HASHES = WordHashes()
RELEASE.append(HASHES.clear)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: bytes.lower() and bytes.split() know ASCII only."""
    return text.encode().lower().split() if text else []


def shingles_of(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words than k count as one shingle, no word as none."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.empty(0, U)
    h = np.fromiter(map(HASHES.__getitem__, words), U, n)
    w = min(k, n)
    acc = mix(h[: n - w + 1] + U(w))
    for j in range(1, w):
        acc = mix(acc + h[j : n - w + 1 + j] * U(0x9E3779B97F4A7C15))
    return np.unique(acc)


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the whole set."""
    two = np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), "<i8")
    return int(two[0]), int(two[1])


class Sizes:
    """Size classes for a similarity of num/den: linked sets lie in the same or in neighbouring classes."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low = num, den, [1]

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        return bisect_right(self.low, n) - 1

    def difference(self, cls: int) -> int:
        """The largest symmetric difference of two linked sets of which the larger is in cls."""
        while len(self.low) < cls + 2:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        return 2 * (self.low[cls + 1] - 1) * (self.den - self.num) // (self.den + self.num)


def position_keys(tokens: np.ndarray, cls: int, d: int, spare: float, tag: int) -> tuple[np.ndarray, bool]:
    """Keys of the index lists that a set enters for class cls, and whether one stands for an empty position.

    Tokens are dealt over K = d + 1 + s positions by their hash. Two sets that differ in at most d tokens
    agree on s + 1 positions or more. Each set skips its s smallest positions, ordered by (tokens, position):
    of the positions on which both agree, the largest is skipped by neither.
    """
    s = int(np.ceil(spare * (d + 1)))
    k = d + 1 + s
    mixed = mix(tokens + U(0xD6E8FEB86659FD93))
    at = (mixed >> U(20)) % U(k)
    at = at.astype(np.int64)
    count = np.bincount(at, minlength=k)
    total = np.zeros(k, U)
    np.add.at(total, at, mixed)
    pick = np.argpartition(count * k + np.arange(k), s)[s:] if s else np.arange(k)
    base = U(xxhash.xxh64_intdigest(f"{tag}:{cls}"))
    return mix(mix(total[pick] + count[pick].astype(U)) + base + pick.astype(U) * U(0x9E3779B97F4A7C15)), bool((count[pick] == 0).any())


def all_keys(tokens: np.ndarray, sizes: Sizes, spare: float, common: np.ndarray | None) -> np.ndarray:
    """Keys for the set's own class and the next larger one. Where no difference is allowed, equal sets are found by fingerprint."""
    cls, out = sizes.of(len(tokens)), []
    rare = tokens if common is None or not len(common) else tokens[common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] != tokens]
    for c in (cls, cls + 1):
        if d := sizes.difference(c):
            keys, empty = position_keys(rare, c, d, spare, 0)
            out.append(keys)
            if empty and len(rare) < len(tokens):  # too few rare tokens to tell sets apart: whole sets are indexed too
                out.append(position_keys(tokens, c, d, spare, 1)[0])
    return np.concatenate(out) if out else np.empty(0, U)


INDEX = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("keys", pa.list_(pa.int64()))])


def slices(batches, rows: int = 500):
    """The batches in parts of few rows: a part's Python objects are all that a task holds."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def index_rows(batches, k, num, den, spare, common=None):
    """(doc_id, text) to INDEX. keys is null for a set that this task has met before, and for null ids and empty sets."""
    sizes, seen = Sizes(num, den), set()
    for batch in slices(batches):
        out: dict[str, list] = {name: [] for name in INDEX.names}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens = shingles_of(text, k)
            fp = fingerprint(tokens) if len(tokens) and doc_id is not None else (None, None)
            keys = None
            if fp[0] is not None and fp not in seen:
                seen.add(fp)
                keys = all_keys(tokens, sizes, spare, common).view(np.int64)
            for name, value in zip(INDEX.names, (doc_id, len(tokens), *fp, keys), strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in INDEX], schema=INDEX)


COUNTS = pa.schema([("token", pa.int64()), ("n", pa.int64())])


def repeated_tokens(batches, k, window=2_000_000):
    """(token, sets) of tokens in two or more distinct sets of this task, counted in windows of `window` tokens.

    By the pigeonhole principle every token in more sets than there are windows is reported.
    """

    def counted(parts):
        token, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], schema=COUNTS)

    seen, parts, held = set(), [], 0
    for batch in slices(batches):
        for text in batch.column(1).to_pylist():
            tokens = shingles_of(text, k)
            if len(tokens) and (fp := fingerprint(tokens)) not in seen:
                seen.add(fp)
                parts.append(tokens)
                held += len(tokens)
            if held > window:
                yield counted(parts)
                parts, held = [], 0
    if parts:
        yield counted(parts)


TOKENS = pa.schema([("cluster", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("min_id", pa.int64()), ("copies", pa.int64()), ("size", pa.int64()), ("blocks", pa.int32()), ("leads", pa.bool_()), ("tokens", pa.list_(pa.int64()))])


def member_tokens(batches, k):
    """(text, cluster, fp1, fp2, min_id, copies, blocks, leads) to TOKENS; rows whose text isn't the class's are left out."""
    for batch in slices(batches):
        rows = {name: [] for name in TOKENS.names}
        for text, cluster, fp1, fp2, min_id, copies, blocks, leads in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tokens = shingles_of(text, k)
            if len(tokens) and fingerprint(tokens) == (fp1, fp2):
                for name, value in zip(TOKENS.names, (cluster, fp1, fp2, min_id, copies, len(tokens), blocks, leads, tokens.view(np.int64)), strict=True):
                    rows[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in TOKENS], schema=TOKENS)


ANSWERS = pa.schema([("fp1", pa.int64()), ("fp2", pa.int64()), ("low", pa.int64()), ("min_id", pa.int64()), ("links", pa.int64())])


def similar_order(apart: list[list[int]]) -> list[int]:
    """The sets, each after one that it has much in common with: sorted by their differences from the leader, rarest token first."""
    n: dict[int, int] = {}
    for tokens in apart:
        for t in tokens:
            n[t] = n.get(t, 0) + 1
    return sorted(range(len(apart)), key=lambda i: sorted((-n[t], t) for t in apart[i]))


def _answer(rows: list[tuple], num: int, den: int, cross: bool) -> list[tuple]:
    """Answers of one pair of blocks. rows: (side, fp1, fp2, min_id, copies, size, difference from the leader).

    With D(Y) = Y xor leader, Y xor Z = D(Y) xor D(Z), so sets are compared by their small differences. A list per
    differing token holds the sets that have it. The answers of the first set (its overlap with every other one) are
    read from its lists; those of each further set are derived from the answers of the set before it, which is chosen to
    be highly similar: the lists of the tokens that only the one has are subtracted, those of the other's are added.
    """
    once = list({(r[1], r[2]): r for r in rows}.values())
    order = similar_order([r[6] for r in once])
    once = [once[i] for i in order]
    m = len(once)
    side = np.array([r[0] for r in once])
    copies = np.array([r[4] for r in once], np.int64)
    size = np.array([r[5] for r in once], np.int64)
    apart = np.array([len(r[6]) for r in once], np.int64)
    lists: dict[int, list[int]] = {}
    for i, r in enumerate(once):
        for token in r[6]:
            lists.setdefault(token, []).append(i)
    held = {t: np.array(x) for t, x in lists.items() if len(x) > 1}
    parent, links = list(range(m)), np.zeros(m, np.int64)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    common, last = np.zeros(m, np.int64), frozenset()
    for i in range(m):
        own = frozenset(held.keys() & once[i][6])
        for t in last - own:
            common[held[t]] -= 1
        for t in own - last:
            common[held[t]] += 1
        last = own
        differ = apart + apart[i] - 2 * common  # |Y xor Z|
        union2 = size + size[i] + differ  # twice the union
        near = den * (union2 - 2 * differ) >= num * union2
        near[i] = False
        if cross:
            near &= side != side[i]
        found = np.flatnonzero(near)
        links[i] = copies[found].sum()
        for j in found[found > i]:
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    low: dict[int, int] = {}
    for i in range(m):
        low[root(i)] = min(low.get(root(i), once[i][3]), once[i][3])
    return [(r[1], r[2], low[root(i)], r[3], int(links[i])) for i, r in enumerate(once)]


def block_answers(batches, num, den):
    """Rows (cluster, p, q, side, fp1, fp2, min_id, copies, size, difference), sorted by (cluster, p, q), to ANSWERS."""
    key, rows, out = None, [], []

    def flush():
        if rows:
            out.extend(_answer(rows, num, den, key[1] != key[2]))
            rows.clear()

    def made():
        columns = list(zip(*out, strict=True)) or [[]] * len(ANSWERS)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ANSWERS, strict=True)], schema=ANSWERS)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != key:
                flush()
                key = row[:3]
            rows.append(row[3:])
        if len(out) > 5_000:
            yield made()
    flush()
    yield made()


FIRSTS = pa.schema([("key", pa.int64()), ("first", pa.int64()), ("doc_id", pa.int64())])


def first_of_key(batches, others: bool, window: int = 2_000_000):
    """(keys, doc_id) to FIRSTS: of each key its smallest doc_id (others false), or the other sets of the list with that one (others true).

    Keys are combined in windows before they are shuffled, so that a list that very many sets enter sends one row a window.
    """

    def combined(keys, ids):
        key, doc = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.r_[True, key[1:] != key[:-1]]
        first = doc[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        take = first != doc if others else new
        return pa.RecordBatch.from_arrays([pa.array(key[take]), pa.array(first[take]), pa.array(doc[take])], schema=FIRSTS)

    keys, ids, held = [], [], 0
    for batch in batches:
        column = batch.column(0)
        keys.append(column.flatten().to_numpy(zero_copy_only=False))
        ids.append(np.repeat(batch.column(1).to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())))
        held += len(keys[-1])
        if held > window:
            yield combined(keys, ids)
            keys, ids, held = [], [], 0
    if held:
        yield combined(keys, ids)
