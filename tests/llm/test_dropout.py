"""Merge-dropout against a plain re-telling of the agenda, and its variety."""

import random

import numpy as np

from quillspark.llm import sentencepiece_bpe as S


def brute(words, unit, key, bound):
    """Take the best candidate, leftmost of equals, out of all neighbours that weren't skipped; skip it or merge it."""
    parts, gone = [(i, i + 1) for i in range(len(unit))], set()
    while True:
        best = min(((words.rank[unit[a:d]][0], a, b, d) for (a, b), (_, d) in zip(parts, parts[1:], strict=False) if unit[a:d] in words.rank and (a, b, d) not in gone), default=None)
        if best is None:
            break
        _, a, b, d = best
        x = ((key ^ (a << 42 | b << 21 | d)) * 0x9E3779B97F4A7C15) % 2**64
        x = ((x ^ x >> 29) * 0xBF58476D1CE4E5B9) % 2**64
        if x >> 32 < bound:
            gone.add((a, b, d))
            continue
        at = parts.index((a, b))
        parts[at : at + 2] = [(a, d)]
    return [i for a, b in parts for i in ([words.rank[unit[a:b]][1]] if unit[a:b] in words.rank else [words.byte.get(x, words.unknown) for x in unit[a:b].encode()])]


def test_batches_and_single_words_equal_brute_force():
    words = S.vocabulary(S.default_model())
    merges, rng = S.Merges(words), random.Random(12)
    units = list({"".join(rng.choice(" theandingers.,é漢😀▁\n0aa") for _ in range(rng.randrange(1, 33))) for _ in range(1500)})
    for dropout in (0.0, 0.1, 0.5, 1.0):
        bound = int(dropout * (1 << 32))
        keys = np.array([S.key_of(3, 1, u) for u in units], np.uint64)
        got = merges.segment(units, keys, bound, chunk=97)
        for u, key, ids in zip(units, keys.tolist(), got, strict=True):
            assert np.frombuffer(ids, words.dtype).tolist() == brute(words, u, key, bound), repr(u)
    for u in units[:300]:
        assert words.segment(u, 3, 1, 0.2) == brute(words, u, S.key_of(3, 1, u), int(0.2 * (1 << 32)))


def test_long_words_are_cut_where_nothing_joins():
    words = S.vocabulary(S.default_model())
    encoder = S.Encoder(S.default_model(), 1, 0.2, 4)
    unit = " " + "thinking漢" * 40 + "0" * 50
    ids = encoder.encode(unit[1:], "d").tolist()
    assert words.decode(ids) == unit[1:]
    atoms = words.atoms(unit)
    assert any([i for a in atoms for i in brute(words, a, S.key_of(1, v, a), int(0.2 * (1 << 32)))] == ids for v in range(4))


def test_a_skip_per_candidate_at_the_stated_rate():
    """Of two-letter pieces each has one candidate: the share that stays apart is the dropout."""
    words = S.vocabulary(S.default_model())
    units = [p for p in words.rank if len(p) == 2][:2000]
    apart = sum(len(words.segment(u, s, 0, 0.1)) == 2 for u in units for s in range(5))
    assert abs(apart / (5 * len(units)) - 0.1) < 0.02


def test_a_very_long_text():
    encoder = S.Encoder(S.default_model(), 1, 0.1, 4)
    text = "lorem ipsum dolor " * 100_000
    assert encoder.vocabulary.decode(encoder.encode(text, 1).tolist()) == text
