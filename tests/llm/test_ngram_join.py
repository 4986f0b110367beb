import random
import re

import pytest

from quillspark.llm.ngram_join import jaccard_classes, keep_one

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, k, num, den):
    sets = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((i, {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()))
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = dict.fromkeys(parent, 0)
    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if a and b and den * len(a & b) >= num * len(a | b):
                links[i] += 1
                links[j] += 1
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: (len(s), root(i), links[i]) for i, s in sets}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "ÄB", "x y"]
    passage = [rng.choice(vocabulary) for _ in range(55)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 9, 12, 20, 60, 150, 400]))]
        if rng.random() < 0.6:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 8])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5, 12])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words = words[: -rng.randint(1, 9)] or words
            rows.append(" ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words))
    rng.shuffle(rows)
    return [(1000 - i, t) for i, t in enumerate(rows)] + [(5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "ONE"), (10, "one")]


@pytest.mark.parametrize("k, num, block", [(3, 90, 1024), (5, 80, 1024), (3, 90, 7), (2, 70, 5)])
def test_equals_brute_force(spark, k, num, block):
    rows = corpus(k * num + block)
    got = jaccard_classes(spark.createDataFrame([(i, t, "a", "b", 1) for i, t in rows], SCHEMA), k=k, num=num, block=block, hot=3)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got.collect()} == brute(rows, k, num, 100)


def test_common_tokens_do_not_change_the_answer(spark, monkeypatch):
    from quillspark.llm import ngram_join

    real = ngram_join.common_tokens
    monkeypatch.setattr(ngram_join, "common_tokens", lambda docs, k: real(docs, k, least=2))
    rows = corpus(3)
    got = jaccard_classes(spark.createDataFrame([(i, t, "a", "b", 1) for i, t in rows], SCHEMA).coalesce(2), k=5)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got.collect()} == brute(rows, 5, 80, 100)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "A b  c\td"), (3, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as cluster", "2 as fp1", "3 as n_shingles")
    got = sorted(((r.doc_id, r.component_id, r.n_links) for r in jaccard_classes(docs, k=3).collect()), key=str)
    assert got == [(1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 3, 0), (None, None, 0)]
    assert sorted((r.doc_id for r in keep_one(docs, k=3).collect()), key=str) == [1, 3, None]


def test_empty_table(spark):
    assert jaccard_classes(spark.createDataFrame([], SCHEMA)).count() == 0
