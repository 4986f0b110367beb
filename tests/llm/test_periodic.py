import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

import pytest

from quillspark.llm import periodic, queries


def period_of(words):
    fail, k = [0] * len(words), 0
    for i in range(1, len(words)):
        while k and words[i] != words[k]:
            k = fail[k - 1]
        k += words[i] == words[k]
        fail[i] = k
    return len(words) - fail[-1]


def brute(words, least=6, times=4):
    out = []
    for q in range(1, len(words) // times + 1):
        same = [words[j] == words[j + q] for j in range(len(words) - q)] + [False]
        first = None
        for j, hit in enumerate(same):
            if hit and first is None:
                first = j
            if not hit and first is not None:
                n = j - first + q
                if n >= max(least, times * q) and period_of(words[first : first + n]) == q:
                    out.append((first, n, q))
                first = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def random_texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        letters = "abcdefgh"[: rng.randrange(1, 8)]
        parts = []
        for _ in range(rng.randrange(1, 6)):
            base = [rng.choice(letters) for _ in range(rng.randrange(1, 9))]
            whole = base * rng.randrange(1, 9)
            parts += whole[: max(1, len(whole) - rng.randrange(3))]
        yield " ".join(parts)


ODD = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a\x0ba\x0ca\ta\ra\na", "b a a a a a a b", "a b " * 4, "a b " * 3 + "a", "é é é é é é", "x\xa0x x\xa0x x\xa0x x\xa0x x\xa0x x\xa0x", ("a " * 6 + "b ") * 5, "ab " * 30_000, "".join(f"w{i % 977} " for i in range(50_000)), "".join(f"w{i} " for i in range(50_000)), "x y z " * 5 + "a b " * 9]


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (5, 3), (12, 2)])
def test_runs_against_brute_force(spark, least, times):
    texts = [t for t in ODD if len(t or "") < 5_000] + list(random_texts(least, 300))
    docs = spark.createDataFrame([(i if i % 7 else None, t, i, "x") for i, t in enumerate(texts)] * 2, "doc_id long, text string, runs int, id string")
    got = sorted((r.id is not None, r.id or 0, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in periodic.find_runs(docs, least=least, times=times).collect())
    want = []
    for i, t in enumerate(texts):
        runs = brute(split(t), least, times)
        want += [(bool(i % 7), i if i % 7 else 0, len(split(t)), runs, collapsed(split(t), runs))] * 2
    assert got == sorted(want)
    assert periodic.find_runs(docs.limit(0)).count() == 0


def test_long_texts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD) if len(t or "") >= 5_000], "doc_id long, text string")
    got = {r.id: [(x.start, x.length, x.period) for x in r.runs] for r in periodic.find_runs(docs).collect()}
    assert got == {13: [(0, 30_000, 1)], 14: [(0, 50_000, 977)], 15: []}


def test_windows_reach_every_run():
    assert periodic.window(6, 4) == 5
    for least, times in [(6, 4), (2, 2), (5, 3), (12, 2), (20, 5)]:
        w = periodic.window(least, times)
        for q in range(1, 60):
            n = max(least, times * q)
            assert all(i >= q or i + q + w <= n for i in range(n - w + 1)) and n - q >= w


def test_places_stay_sorted():
    rng, some = random.Random(3), list(range(5_000))
    rng.shuffle(some)
    places = periodic.Places(some[0])
    for i, x in enumerate(some[1:2_000], 1):
        known = sorted(some[:i])
        before, after = places.add(x)
        assert before == max((k for k in known if k < x), default=None) and after == min((k for k in known if k > x), default=None)
    assert list(places) == sorted(some[:2_000])


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, t) for i, t in enumerate([*(t for t in ODD if len(t or "") < 5_000), *random_texts(5, 120), *(" ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(150))) for _ in range(150))])] + [(None, "a " * 9), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for doc_id, text in rows:
        words = split(text)
        n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        digest = sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((doc_id, len(runs), *four, digest, sha256(collapsed(words, runs).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want) > 30
