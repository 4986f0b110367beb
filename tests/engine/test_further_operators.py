"""What the queries' SQL doesn't reach: word rules, folds, prefix sums in buckets, splits by weight, prompts, block products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import obligations as O
from quillspark.functions import text as T
from quillspark.operators import annotate, curate, evaluate, retrieve, route, segment
from quillspark.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, f2", [
    ("Scope: the operator keeps to it; it must be so.", True), ("Appendix A: the operator must keep records.", False), ("must do it", False), (None, False),
    ("The operator is responsible for the records.", True), ("The mustard is required here today.", True), ("Nothing of the kind is said in here.", False), ("Version 2 shall be kept by the operator.", False),
])
def test_source_rule(spark, text, f2):
    assert one(spark, O.by_rule(F.lit(text).cast("string"))) is f2


def test_typed_obligations_follow_the_source(spark):
    got = one(spark, O.typed(F.lit("Staff shall not share keys. They are required to log it. Must. No end that must hold")))
    assert [(x.type, x.text) for x in got] == [("shall", "Staff shall not share keys."), ("required", "They are required to log it."), ("shall_not", "Staff shall not share keys.")]
    assert one(spark, O.typed(F.lit(None).cast("string"))) == [] and len(one(spark, O.typed(F.lit("x" * 300_000 + " shall be.")))) == 1


def test_model_or_rule(spark):
    rows = spark.createDataFrame([(1, "The operator shall keep it."), (2, "nothing")], "id long, text string")
    assert [r.id for r in O.by_model(rows, "text").where("obliges").collect()] == [1]
    assert [r.id for r in O.by_model(rows, "text", lambda f: f["text"].str.len() / 10.0, 1.0).where("obliges").collect()] == [1]


def test_assignment_reply_falls_back(spark):
    f = lambda s: one(spark, annotate.assignment_reply(F.lit(s)))
    assert f("EVIDENCE: no\nPARTIAL: yes")["assignment"] == "PARTIAL" and f("")["status"] == "Not Addressed"
    assert f("ASSIGNMENT: partially correct")["assignment"] == "CORRECT" and f("PASSAGE_ABOUT: [a]\r\nREASON: b: c")[:2] == ("a", "")
    assert f("REASON: b: c")["reason"] == "b: c" and f("EVIDENCE: maybe")["evidence"] is None


def test_paragraph_chunks(spark):
    paragraphs = ["a" * 40, "short", "b" * 40, "c" * 70, "d" * 200, "e" * 25]
    docs = spark.createDataFrame([(1, "\n \n".join(paragraphs)), (2, None)], "d long, t string")
    got = [r.text for r in segment.paragraph_chunks(docs, "d", F.col("t"), 100, 30, 20).orderBy("n").collect()]
    assert got == ["a" * 40 + " " + "b" * 40, "c" * 70, "d" * 200]


def test_hierarchical_passages(spark):
    docs = spark.createDataFrame([(1, "preface line\n1.1 Scope of it\nText one.\nmore\n5) Roles\nStaff shall do all of this.\n2 Exceptions\n"), (2, None)], "d long, t string")
    got = segment.hierarchical_passages(docs, "d", F.col("t"), O.typed).orderBy("n").collect()
    assert [(r.section_id, r.section_title, r.content, r.scope, r.role, len(r.obligations)) for r in got] == [
        ("", "Section", "preface line", False, False, 0), ("1.1", "Scope of it", "Text one. more", True, False, 0), ("1.1", "5) Roles", "Staff shall do all of this.", False, True, 1),
    ]


def test_global_sweeps_without_one_window(spark):
    rng = np.random.default_rng(0)
    values = [(float(x), bool(y)) for x, y in zip(rng.integers(0, 500, 4000) / 100, rng.random(4000) < 0.3, strict=True)]
    rows = spark.createDataFrame(values, "s double, y boolean")
    got = {r.threshold: (r.tp, r.fp, r.fn) for r in evaluate.threshold_sweep(rows, "s", "y").collect()}
    positives = sum(y for _, y in values)
    for t in {s for s, _ in values}:
        tp = sum(y for s, y in values if s >= t)
        assert got[t] == (tp, sum(not y for s, y in values if s >= t), positives - tp)


def test_cosine_blocks_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 8))
    rows = spark.createDataFrame([(i, v.tolist(), f"g{i % 7}") for i, v in enumerate(vectors)] + [(900, None, "g0"), (901, [1.0], "g0")], "id long, embedding array<double>, g string")
    asks = rows.where("id % 10 = 0").withColumnRenamed("id", "q")
    norm = np.linalg.norm(vectors, axis=1)
    want = {(q, i): round(float(vectors[q] @ vectors[i] / (norm[q] * norm[i] + 1e-9)), 6) for q in range(0, 300, 10) for i in range(300) if i != q}
    top = retrieve.cosine(rows, asks, doc="id", query="q", k=4, shard_rows=50, block=7).where("q < 900").collect()
    for q in range(0, 300, 10):
        best = sorted(((-s, i) for (p, i), s in want.items() if p == q))[:4]
        assert [(r.id, r.score) for r in sorted((r for r in top if r.q == q), key=lambda r: r["rank"])] == [(i, -s) for s, i in best]
    groups = {(r.q, r.g): r.score for r in retrieve.cosine(rows, asks, doc="id", query="q", by="g", shard_rows=50, block=7).where("q < 900").collect()}
    assert groups == {(q, f"g{k}"): m for q in range(0, 300, 10) for k in range(7) if (m := max(s for (p, i), s in want.items() if p == q and i % 7 == k)) > 0}


def test_neighbours_of_large_groups(spark):
    corpus = spark.range(1000).selectExpr("id as d", "id % 2 as g")
    found = spark.createDataFrame([(1, 0), (1, 2), (2, 5)], "q long, d long")
    got = [(r.q, r.d, r["rank"]) for r in retrieve.neighbours(found, corpus, "q", "d", "g", 3).orderBy("q", "rank").collect()]
    assert got == [(1, 4, 1), (1, 6, 2), (1, 8, 3), (2, 1, 1), (2, 3, 2), (2, 7, 3)]


def test_a_large_dictionary_is_met_in_parts(spark):
    texts = spark.createDataFrame([(1, "Alpha beta"), (2, "gamma"), (3, None)], "k long, t string")
    words = spark.createDataFrame([("a", "alpha"), ("b", "BETA"), ("c", "amma"), ("c", None)], "o string, w string")
    got = {(r.k, r.o, r.w, r.size) for r in route.keyword_hits(texts, "k", F.col("t"), words, "o", "w", most=1).collect()}
    assert got == {(1, "a", "alpha", 5), (1, "b", "BETA", 4), (2, "c", "amma", 4)}


def test_split_weight_combine(spark):
    real = spark.range(400).selectExpr("id as key", "'real_fa' as kind")
    made = spark.range(3).selectExpr("id + 1000 as key", "'synthetic' as kind")
    train, dev = curate.training_split(real, made, ["key"], "kind")
    d = {r.key for r in dev.collect()}
    assert 30 < len(d) < 90 and not d & {r.key for r in train.collect()} and train.count() == 3 * (400 - len(d)) + 3


def test_small_functions(spark):
    f = lambda c: one(spark, c)
    assert f(T.applicability_list(F.lit(None).cast("string"))) == [] and f(T.applicability_found(F.lit("Priority P3, always so"))) == ["P3", "always"]
    assert f(T.last_updated(F.lit(None).cast("string"), default="d")) == "d" and f(T.first_of_enum(F.array(F.lit("x")), ["y"])) == "x"
    assert f(T.status_of_score(F.lit(0.05))) == "Not Addressed" and f(T.status_of_score(F.lit(0.9))) == "Fully Addressed"
    assert [tuple(r) for r in f(T.roles_of(F.lit("Owner - keeps it - all\nrest")))] == [("Owner", "keeps it - all"), ("", "rest")]
    assert f(T.id_depth(F.lit("M1.2.3"))) and not f(T.id_depth(F.lit("M1.2"))) and f(T.like_glob(F.lit("a_1.json"), "a_?.js*"))


def test_ordinals_are_gapless_over_nulls_ties_and_empty_tables(spark):
    rows = spark.createDataFrame([(3, "a"), (None, "b"), (1, "c"), (3, "d"), (1, "e"), (None, "f")], "k int, _n string")
    got = readers.with_ordinal(rows, ["k", "_n"]).orderBy("ordinal").collect()
    assert [(r._n, r.ordinal) for r in got] == [("b", 0), ("f", 1), ("c", 2), ("e", 3), ("a", 4), ("d", 5)]
    tied = readers.with_ordinal(rows, ["k"]).collect()
    assert sorted(r.ordinal for r in tied) == list(range(6)) and {r.ordinal for r in tied if r.k == 1} == {2, 3}
    assert readers.with_ordinal(rows.where("k > 9"), ["k"]).collect() == []
