import math
import random
import re
from fractions import Fraction

import pytest

from quillspark.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(UPPER))


def blocks(words, size):
    """Every half window begins a block, as long as more than half a window is left; a short list is one."""
    s = 0
    while words and (s == 0 or s + size // 2 < len(words)):
        yield s, words[s : s + size]
        s += size // 2


def brute(text, templates, share, phrases=licenses.PHRASES):
    words, out = split(text), []
    sets = [(label, set(split(t)), len(split(t))) for label, t in templates]
    window = max([licenses.WINDOW, *(2 * n for _, _, n in sets)])
    every = [(s, b, True) for s, b in blocks(words, window)]
    first = 0
    for line in (text or "").split("\n"):
        own = split(line)
        every += [(first + s, b, False) for s, b in blocks(own, licenses.LINE)]
        first += len(own)
    for s, block, long in every:
        found = {}
        for t, (label, tokens, n) in enumerate(sets):
            if (n > licenses.LINE // 2) == long and len(tokens & set(block)) >= math.ceil(Fraction(*share) * len(tokens)):
                found[t] = (Fraction(len(tokens & set(block)), len(tokens)), len(tokens), -t)
        for t, rank in found.items():
            rivals = [u for u in found if 2 * len(sets[u][1] & sets[t][1]) >= min(len(sets[u][1]), len(sets[t][1]))]
            if rank == max(found[u] for u in rivals):
                out.append((s, s + len(block) - 1, t, sets[t][0], float(rank[0])))
    places = sorted((i, label) for phrase, label in phrases for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    return len(words), places, sorted(out)


ODD = [None, "", "\n\n", "UNDER the MIT license", "under\nthe mit\nlicense", "İunder the mit license", "under the mit licenseé", "cc by nc" * 3, "CC-BY.NC cc by nc by nc", "x" * 100_000, "Licensed under CC BY 4.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "This work is licensed under the GNU General Public License, version 3.", "apache license, version 2.0 " * 40, "a \x00 b\x7f c\x0b d\x85e"]


def texts_of(seed, templates):
    rng = random.Random(seed)
    pool = [w for _, t in templates for w in t.split()] + ["lorem", "ipsum", "\n", "é", "-"]
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(6)):
            own = rng.choice(templates)[1].split()
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = rng.choice(pool)
            parts += own + rng.choices(pool, k=rng.randrange(40)) + rng.choice([[], ["\n"], ["\n", "\n"]])
        yield " ".join(parts)


SMALL = [("a", "a b c d e"), ("b", "a b c d e f"), ("c", "a a a a"), ("d", "x"), ("e", " -- "), ("f", " ".join(f"w{i % 30}" for i in range(80)))]


@pytest.mark.parametrize(("templates", "share"), [(licenses.TEMPLATES, (9, 10)), (licenses.TEMPLATES, (1, 2)), (SMALL, (4, 5)), (SMALL, (1, 1))])
def test_join_against_brute_force(spark, templates, share):
    texts = ODD + list(texts_of(share[0], templates))
    docs = spark.createDataFrame([(i if i % 9 else None, t, i, "x") for i, t in enumerate(texts)] * 2, "doc_id long, text string, n_words int, matches string")
    got = sorted(((r.id, r.n_words, [tuple(p) for p in r.places], [tuple(m) for m in r.matches]) for r in licenses.scan(docs, templates=templates, share=share).collect()), key=str)
    named = [t for t in templates if split(t[1])]
    want = [(i if i % 9 else None, *brute(t, named, share)) for i, t in enumerate(texts)] * 2
    assert got == sorted(want, key=str)
    assert sum(bool(w[3]) for w in want) > 20
    assert licenses.scan(docs.limit(0)).count() == 0


def test_rarest_words_come_first():
    made = licenses.Templates.build([("x", "the mit license of the web")], {b"the": 90, b"mit": 1, b"license": 5, b"web": 7, b"of": 80}, (4, 5))
    assert sorted(made.rank, key=made.rank.get) == [b"mit", b"license", b"web", b"of", b"the"]
    assert made.signals == {b"mit", b"license"} and made.needs == [4]


def test_query_has_the_base_and_the_methods_labels(spark, tmp_path):
    rows = [(1, ODD[11]), (2, "x under the MIT license, CC BY-NC; under the mit License"), (3, None), (4, "nothing"), (None, "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_license_scan(spark, str(tmp_path)).collect()}
    assert got == {1: (13, 0, None, None, "", "lgpl-3", 1.0), 2: (12, 3, 1, 8, "cc-by-nc,mit", "cc-by-nc,mit", 1.0), 3: (0, 0, None, None, "", "", 0.0), 4: (1, 0, None, None, "", "", 0.0), None: (21, 0, None, None, "", "bsd", 1.0)}


def test_a_list_too_large_is_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="parts of the list"):
        licenses.scan(docs, templates=[("x", "a " * 1_000_001)])
