"""Very long texts, repeated rows, clashing columns and null ids for the operators that the other tests don't try with them; recall of the forest."""

import base64
import math
import random
import time

import numpy as np
import pytest

import corpus_pipeline
from quillspark.llm import ann_forest, ngram_join, packing, repetition, secrets, token_store
from quillspark.llm._spark import materialize, shared_dir, workspace

RATIO = {c: i for i, c in enumerate(secrets.ALPHABET)}


def brute_ratio(value, model):
    n = len(secrets.ALPHABET)
    return sum(model[RATIO[a] * n + RATIO[b]] for a, b in zip(value, value[1:], strict=False))


@pytest.fixture(scope="module")
def model(spark):
    words = "the quick analysis of number value index count total result handler request parser buffer stream window member system".split()
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(300))) for i in range(8)], "doc_id long, text string")
    return secrets.train(secrets.labelled_samples(docs, "text", 100))


def test_the_score_of_every_run_and_its_verdict(spark, model):
    rng = random.Random(3)
    values = ["".join(rng.choice(secrets.ALPHABET) for _ in range(rng.randrange(20, 90))) for _ in range(150)] + ["request_handler_window_buffer_stream", "A" * 20, "x" * 5000]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, value string")
    got = {r.i: r.score for r in rows.select("i", secrets.ratio(rows["value"], model).alias("score")).collect()}
    rounded = [round(x, 6) for x in model]
    assert all(math.isclose(got[i], brute_ratio(v, rounded), rel_tol=1e-9, abs_tol=1e-6) for i, v in enumerate(values))
    docs = spark.createDataFrame([(i, f"é {v} .") for i, v in enumerate(values)], "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r.secrets if s.kind == 3] for r in secrets.scan(docs, model=model).collect()}
    base = {r.doc_id: any(s.kind < 3 for s in r.secrets) for r in secrets.scan(docs, model=model).collect()}
    for i, v in enumerate(values):
        if not base[i]:
            assert found[i] == ([(2, 2 + len(v))] if brute_ratio(v, rounded) >= max(12.0, 0.6 * len(v)) else [])


def test_secret_scan_of_long_texts_and_many_matches(spark, model):
    rng = np.random.default_rng(0)
    image = base64.b64encode(rng.bytes(750_000)).decode()
    many = "token=abcdefgh1 plain words here " * 20_000
    docs = spark.createDataFrame([(1, image), (2, many), (2, many), (None, None)], "doc_id long, text string").selectExpr("*", "1 as spans", "2 as start")
    began = time.time()
    got = {r.doc_id: (len(r.secrets), len(r.text or "")) for r in secrets.redact(secrets.scan(docs, model=model), model=model).collect()}
    assert got[1][0] == 1 and got[2] == (20_000, len(many) - 20_000 * (len("token=abcdefgh1") - len("[SECRET]"))) and got[None] == (0, 0)
    assert time.time() - began < 60  # a pass that took the square of either would take hours


def test_quality_rules_of_long_and_repeated_texts(spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120_000))
    docs = spark.createDataFrame([(1, long), (2, "one two three"), (2, "one two three"), (3, "a b " * 50_000)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.kept) for r in repetition.quality_rules(docs).collect())
    assert got == [(1, 120_000, True), (2, 3, False), (2, 3, False), (3, 100_000, False)]


def test_long_texts_in_the_join_the_packing_and_the_store(spark, tmp_path):
    words = [f"w{i}" for i in range(60_000)]
    near = [*words[:59_000], "other", *words[59_001:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, "x" * 300_000), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_classes(docs, k=3, num=90).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    pieces = packing.pack(docs).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(pieces) == 4 and all(r["sum(length)"] == r["max(doc_tokens)"] for r in pieces)
    assert [r.doc_id for r in token_store.round_trip(docs, shards=2).orderBy("start").collect()] == [1, 2, 3, 4]


def recall_and_share(vectors, queries, k=20):
    norm = float(np.sqrt((vectors**2).sum(axis=1).max()))
    forest = ann_forest.Forest(vectors, norm, 24, 48, 7)
    hits = compared = 0
    for q, (at, rough, n) in zip(queries, forest.search(vectors[queries], [np.array([q]) for q in queries], k, 0.92), strict=True):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        hits += len(set(at[np.argsort(-rough)][:k]) & set(np.argsort(-scores)[:k]))
        compared += n
    return hits / (k * len(queries)), compared / (len(queries) * len(vectors))


def test_recall_and_share_on_uniform_and_clustered_vectors():
    rng = np.random.default_rng(5)
    uniform = rng.normal(size=(10_000, 64))
    uniform /= np.linalg.norm(uniform, axis=1)[:, None]
    centres = rng.normal(size=(200, 64))
    clustered = centres[rng.integers(0, 200, 10_000)] + 0.3 * rng.normal(size=(10_000, 64))
    queries = np.arange(0, 10_000, 100)
    recall, share = recall_and_share(uniform, queries)
    assert recall >= 0.93 and share < 0.9
    recall, share = recall_and_share(clustered, queries)  # of uneven length: the lifted vectors are farther apart
    assert recall >= 0.9 and share < 0.3
    recall, share = recall_and_share(clustered / np.linalg.norm(clustered, axis=1)[:, None], queries)
    assert recall >= 0.9 and share < 0.02


def test_pipeline_with_null_ids_repeats_and_clashing_columns(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text + " x"), (None, text), (3, None), (4, ""), (5, " ".join(f"v{i}" for i in range(70)) + " token=abcdefghijk")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars", "1 as component_id", "2 as secrets", "3 as _before")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
    left = sorted(((r.doc_id, r.n_chars) for r in docs.collect()), key=str)
    assert [i for i, _ in left] == [1, 5, None] and docs.columns[-3:] == ["component_id", "secrets", "_before"]
    assert {p.doc_id for p in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 5, None}


def test_a_workspace_is_deleted(spark):
    from pathlib import Path

    with workspace(spark):
        table = materialize(spark.range(5), "gone")
        assert table.count() == 5
        folder = Path(shared_dir(spark).removeprefix("file://")) / "quillspark"
        names = list(folder.glob("gone-*"))
        assert names
    assert not any(n.exists() for n in names)
