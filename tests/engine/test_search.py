"""Block-max BM25 against brute force, and how many documents it scores."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import search


def brute(docs, asks, k, grouped):
    """(query, group, doc, score, rank) with docs as (group, key, text)."""
    out = []
    for g in sorted({d[0] if grouped else 0 for d in docs}):
        own = [d for d in docs if not grouped or d[0] == g]
        words = {key: (text or "").lower().split() for _, key, text in own}
        n, avgdl = len(own), sum(map(len, words.values())) / len(own)
        df = Counter(w for ws in words.values() for w in set(ws))
        raw = {w: math.log(n - x + 0.5) - math.log(x + 0.5) for w, x in df.items()}
        floor = 0.25 * sum(raw.values()) / max(1, len(raw))
        for q, text in asks:
            scores = []
            for key, ws in words.items():
                tf = Counter(ws)
                s = sum(c * (raw[w] if raw[w] >= 0 else floor) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / avgdl)) for w, c in Counter((text or "").lower().split()).items() if w in tf)
                s = math.floor(s * 1e6 + 0.5) / 1e6
                if s > 0:
                    scores.append((-s, key))
            out += [(q, g, key, round(-s, 6), i + 1) for i, (s, key) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def corpus(rng, n, groups=3):
    pool = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3_000)]
    docs = [(rng.choice(range(groups)), f"d{i:04}", " ".join(rng.choices(pool, k=rng.randrange(60)))) for i in range(n)]
    return docs + [(0, "e1", None), (1, "e2", ""), (0, "copy1", docs[0][2]), (0, "copy2", docs[0][2])]


@pytest.mark.parametrize(("grouped", "k", "shard_rows", "query_block"), [(False, 5, 32_768, 8_192), (True, 3, 32_768, 8_192), (False, 4, 40, 6), (True, 7, 40, 6), (True, 10_000, 100, 8_192)])
def test_same_rows_as_scoring_everything(spark, grouped, k, shard_rows, query_block):
    rng = random.Random(k)
    docs = corpus(rng, 400)
    asks = [(i, rng.choice(docs)[2] if i % 2 else "w1 w2 W1 nowhere") for i in range(20)] + [(20, None), (21, "nowhere")]
    table = spark.createDataFrame(docs + [(0, None, "w1 w1")], "g long, key string, text string")
    got = search.bm25(table, spark.createDataFrame(asks, "q long, ask string"), doc="key", text=F.col("text"), query="q", query_text=F.col("ask"), group=["g"] if grouped else None, k=k, shard_rows=shard_rows, query_block=query_block)
    rows = sorted((r.q, r.g if grouped else 0, r.key, r.score, r["rank"]) for r in got.collect())
    assert rows == brute(docs, asks, k, grouped)
    nothing = search.bm25(table.limit(0), spark.createDataFrame(asks, "q long, ask string"), doc="key", text=F.col("text"), query="q", query_text=F.col("ask"), k=k)
    assert nothing.count() == 0


def shard_of(docs):
    """A shard in which term t weighs docs[i][t] in document i."""
    rows = [(i, t, w) for i, own in enumerate(docs) for t, w in own.items()]
    number, term, weight = map(np.array, zip(*rows, strict=True))
    return search.Shard(np.zeros(len(rows), np.int64), number, term, weight)


def test_few_documents_are_scored_where_all_hold_the_same_words():
    rng = random.Random(1)
    common = {t: 0.1 for t in range(10)}
    docs = [dict(common) for _ in range(20_000)]
    for i in rng.sample(range(20_000), 8):
        docs[i][100] = 5.0
    index = shard_of(docs)
    ask = np.array([*range(10), 100])
    at, score = index.top(ask, np.ones(11, np.int64), 5)
    want = sorted((-round(sum(d.values()), 6), i) for i, d in enumerate(docs))[:5]
    assert sorted(zip((-score).round(6), index.doc[at], strict=True)) == want
    assert index.scored < 0.03 * len(docs)  # 16 blocks of 32, in three rounds
    # Without a rare word every score is the same: the first documents win, and the others are not looked at.
    index.scored = 0
    at, _ = index.top(np.arange(10), np.ones(10, np.int64), 5)
    assert sorted(index.doc[at]) == [0, 1, 2, 3, 4] and index.scored < 0.01 * len(docs)


def test_negative_weights_bound_nothing_from_above():
    docs = [{1: -3.0, 2: 1.0 + i / 100} for i in range(200)] + [{2: 1.5}]
    index = shard_of(docs)
    at, score = index.top(np.array([1, 2]), np.array([1, 1]), 3)
    assert list(index.doc[at]) == [200] and list(score) == [1.5]
