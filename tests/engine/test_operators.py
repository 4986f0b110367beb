
import json

import pytest
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.functions import text as T
from quillspark.operators import annotate, curate, evaluate, retrieve, route, score, segment
from quillspark.plans import mapping
from quillspark.sources import readers, sinks
from quillspark.streaming import events


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


def test_two_precisions(spark):
    p = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "control_id long, passage_id long")
    g = spark.createDataFrame([(1, 1, True, False), (1, 2, False, True)], "control_id long, passage_id long, positive boolean, negative boolean")
    r = evaluate.confusion(p, g).first()
    assert (r.tp, r.fp, r.fn, r.precision_all, r.precision_judged) == (1, 1, 0, 0.333333, 0.5)


def test_hit_rate_counts_any_gold(spark):
    gold = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "query_id long, doc_id long")
    log = spark.createDataFrame([(1, 5, 1), (1, 9, 2)], "query_id long, doc_id long, rank int")
    assert evaluate.hit_rate(log, gold, [1]).first().hit_rate_at_k == 0.5


def test_sweep_is_one_dimensional(spark):
    rows = spark.createDataFrame([(0.9, True), (0.6, False), (0.5, True), (0.1, False)], "s double, y boolean")
    best = evaluate.threshold_sweep(rows, "s", "y").orderBy(F.desc("f1")).first()
    assert (best.threshold, best.f1) == (0.5, 0.8)


@pytest.mark.parametrize("before, n", [(False, 1), (True, 2)])
def test_blocklist_before_or_after_the_cut(spark, before, n):
    q = spark.createDataFrame([(1, "alpha beta gamma", "F")], "query_id long, text string, family string")
    texts = ["alpha beta gamma", "alpha beta x", "alpha y z", *["other"] * 9]
    passages = spark.createDataFrame([("d", i, t, i) for i, t in enumerate(texts)], "doc_id string, passage_id long, text string, ordinal long")
    blocked = spark.createDataFrame([(0,)], "passage_id long")
    options = mapping.Options(candidates=2, per_document=2, full=0.9, partial=0.1, block_before=before)
    got, log = mapping.control_centric(q, passages, options, blocked_passages=blocked)
    assert got.count() == n and log.count() == 2
    elsewhere = spark.createDataFrame([("other", "F")], "doc_id string, family string")
    assert mapping.control_centric(q, passages, options, routing=elsewhere)[0].count() == 0
    routed = spark.createDataFrame([("d", "F")], "doc_id string, family string")
    assert mapping.control_centric(q, passages, options, routing=routed)[0].count() == 2


def test_vote_cap_and_keep_best(spark):
    rows = spark.createDataFrame([(1, "full", 0), (1, "none", 1), (1, "none", 2), (2, "full", 3), (2, "none", 4)], "k long, y string, o long")
    got = {r.k: (r.y, r.o) for r in curate.vote(rows, ["k"], "y", {"none": 0, "full": 2}, "o").collect()}
    assert got == {1: ("none", 1), 2: ("full", 3)}
    assert curate.cap(spark.createDataFrame([(1, i, i == 4) for i in range(5)], "p long, o long, pos boolean"), ["p"], ~F.col("pos"), ["o"], 2).count() == 3
    best = curate.keep_best(spark.createDataFrame([("a", 0.7, 1), ("a", 0.7, 2), ("a", 0.0, 3)], "k string, s double, o long"), ["k"], "s", "o").first()
    assert (best.s, best.o) == (0.7, 1)


def test_chunks_and_sections(spark):
    assert one(spark, segment.chunk_numbers(F.array(*(F.lit("x" * n) for n in (400, 400, 400, 1200))), 1000)) == [0, 0, 1, 2]
    docs = spark.createDataFrame([(1, "# A\none\n# B\ntwo"), (2, "plain"), (3, None)], "d long, t string")
    assert [(r.d, r.section, r.text) for r in segment.markdown_sections(docs, "d", F.col("t")).orderBy("d", "n").collect()] == [(1, "A", "one"), (1, "B", "two"), (2, "", "plain")]
    lines = spark.createDataFrame([(1, "intro words that are long enough\n1. SCOPE\nthis text belongs to the scope section.")], "d long, t string")
    assert [r.section for r in segment.lines_to_passages(lines, "d", F.col("t")).collect()] == ["", "1. SCOPE"]
    blocks = spark.createDataFrame([(1, "x T1.2.3 first M4.5.6 second")], "d long, t string")
    assert [(r.id, r.text) for r in segment.id_blocks(blocks, "d", F.col("t")).collect()] == [("T1.2.3", "first"), ("M4.5.6", "second")]
    nested = one(spark, segment.nested_list(F.lit("1. top\na) one\nb) two\n2. next")))
    assert [(x.text, x["sub"]) for x in nested] == [("top", ["one", "two"]), ("next", [])]


def test_rank_fusion_and_fallback(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "q long, d string, rank int")
    b = spark.createDataFrame([(1, "b", 1), (1, "d", 2)], "q long, d string, rank int")
    first = retrieve.fuse(a, b, ["q", "d"], ["q"], "d").orderBy("rank").first()
    assert (first.d, first.score) == ("b", round(1 / 62 + 1 / 61, 9))


def test_text_functions(spark):
    f = lambda c: one(spark, c)
    assert f(T.tokens(F.lit(" a  B "))) == ["a", "b"] and f(T.tokens(F.lit(""))) == []
    assert f(T.document_id(F.lit("P 6_passage_3"))) == "P 6" and f(T.document_id(F.lit(None).cast("string"))) == "_unknown_"
    assert f(T.first_filled(F.lit(None).cast("string"), F.lit(" "), F.lit("v"))) == "v"
    assert f(T.once_if_doubled(F.lit("abab"))) == "ab"
    assert f(T.number_and_name(F.lit("T1.2 - Name"))) == ("T1.2", "Name") and f(T.number_and_name(F.lit("Name"))) == (None, "Name")
    assert f(T.references(F.lit("T1.1 T2.2 T1.1"), r"T\d\.\d", F.lit("T1.1"))) == ["T2.2"]
    assert f(T.letter_numbered(F.array(F.lit("x"), F.lit(" "), F.lit("y")), F.lit("T1"))) == ["T1.a: x", "T1.b: y"]
    assert f(T.unit_confidence(F.lit(None).cast("int"))) == 0.5 and f(T.longest(F.lit("a"), F.lit("bb"), F.lit("cc"))) == "bb"
    assert f(T.ancestor(F.lit("T2.1.1.a"), 2)) == "T2.1" and f(T.safe_double(F.lit("x"))) == 0.0 and f(T.safe_double(F.lit("1.5"))) == 1.5
    assert f(T.is_obligation(F.lit("The operator shall keep a record."))) and not f(T.is_obligation(F.lit("Scope: the operator shall keep it.")))


def test_judge_replies(spark):
    f = lambda c: one(spark, c)
    assert f(annotate.judge_reply(F.lit("VERDICT: Fully\nREASON: r\nASSIGNMENT: correct"))) == ("FULLY", "r", "CORRECT")
    assert f(annotate.judge_reply(F.lit("VERDICT: Partially")))["assignment"] == "CORRECT" and f(annotate.judge_reply(F.lit("")))["assignment"] == "WRONG"
    assert f(annotate.free_reply(F.lit("it is not fully addressed"))) == "Fully Addressed"
    assert f(annotate.checklist_reply(F.lit("Q1: yes\nQ2: no\nQ3: YES"))) == (2, "Partially Addressed")
    replies = spark.createDataFrame([(1, "CONTROL_ID: T1.1.1\nREASON: a\nCONTROL_ID: T2.2.2\nREASON: b")], "k long, r string")
    assert [(r.control_id, r.reason) for r in annotate.negative_sets(replies, "k", "r").collect()] == [("T1.1.1", "a"), ("T2.2.2", "b")]


def test_scans_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "p_passage_1", "text": "x"}]))
    (tmp_path / "one.json").write_text(json.dumps({"id": "q", "text": "y"}))
    (tmp_path / "map.json").write_text(json.dumps({"c": ["p1", "p2"]}))
    (tmp_path / "l.jsonl").write_text('{"id": "a"}\n\n{bad\n{"id": "b"}\n')
    (tmp_path / "t.csv").write_text('name,x\n"a, b",1\n')
    (tmp_path / "ids.txt").write_text("b\n# no\n\na\n")
    at = str(tmp_path)
    assert readers.json_array(spark, f"{at}/a.json", schemas.PASSAGES).first().id == "p_passage_1"
    assert readers.json_array(spark, f"{at}/one.json", schemas.PASSAGES).count() == 1
    assert [(r.id, r["rank"], r.item) for r in readers.keyed_object(spark, f"{at}/map.json", "array<string>").collect()] == [("c", 0, "p1"), ("c", 1, "p2")]
    assert [r.id for r in readers.json_lines(spark, f"{at}/l.jsonl", "id string").collect()] == ["a", "b"]
    assert readers.csv_table(spark, f"{at}/t.csv", {"name": "", "y": "none"}).first() == ("a, b", "none")
    assert [r.id for r in readers.id_list(spark, f"{at}/ids.txt").collect()] == ["a", "b"]
    assert readers.first_existing(spark, [f"{at}/none", f"{at}/a.json"]) == f"{at}/a.json"
    rows = spark.createDataFrame([("d", 1, "s", "t"), ("d", 2, "u", "v")], "doc string, o int, sec string, t string")
    sinks.json_report(rows, f"{at}/report")
    assert spark.read.json(f"{at}/report", multiLine=True).count() == 2
    assert sinks.per_document(rows, "doc", f"{at}/per").first() == ("d", 2)
    assert sinks.banner_text(rows, "doc", "sec", "t", "o").first().text == "=== s ===\nt\n\n=== u ===\nv"
    sinks.append_run(rows, f"{at}/log")
    sinks.append_run(rows, f"{at}/log")
    assert spark.read.json(f"{at}/log").count() == 4 and sinks.resume(rows, rows.limit(1), ["o"]).count() == 1
    export = [{"data": {"k": "1"}, "annotations": [{"result": [{"from_name": "status", "value": {"choices": ["Full"]}}, {"from_name": "confidence", "value": {"choices": ["5 - High"]}}]}]}, {"data": {"k": "2"}, "annotations": []}]
    (tmp_path / "e.json").write_text(json.dumps(export))
    got = annotate.annotations(readers.json_array(spark, f"{at}/e.json", schemas.EXPORT)).collect()
    assert [(r.status, r.confidence) for r in got] == [("Full", 5)]


def test_routes_crosswalk_and_scorer(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k long, owner string")
    b = spark.createDataFrame([(2, "z")], "k long, owner string")
    assert sorted(map(tuple, route.crosswalk(a, b, "k").collect())) == [(1, "x", "none"), (1, "y", "none"), (2, "none", "z")]
    pairs = spark.createDataFrame([(1, "a b", "b c")], "k long, q string, t string")
    assert score.rescore(pairs, "q", "t").first().score == 0.5
    assert score.rescore(pairs, "q", "t", lambda frame: frame["text"].str.len()).first().score == 3.0
    assert route.extract_answer(pairs.selectExpr("k", "'b' q", "'no. has b here. b' t"), ["k"], F.col("q"), F.col("t"), 1).first().answer == "has b here"


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 01:00:00", "a", 1.0), ("2024-01-01 02:00:00", "a", 2.0), ("2024-01-09 00:00:00", "b", 1.0)], "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) ts", "event_type", "value")
    rows.write.parquet(f"{tmp_path}/in")
    query = events.windowed_counts(events.event_stream(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r.event_type, r.n, r.total) for r in spark.table("w").collect()} == {("a", 2, 3.0), ("b", 1, 1.0)}


def test_family_menu_reads_whole_passages(spark):
    from quillspark.plans import inventory

    docs = spark.createDataFrame([(1, "x " * 300 + "dans"), (2, "dans")], "doc_id long, text string").selectExpr("*", "'en' as lang")
    read = lambda name: docs
    assert {r.doc_id: (r.family, r.hits) for r in inventory.menu(read).collect()} == {1: ("C", 1), 2: ("C", 1)}


def test_numbered_sections(spark):
    from pyspark.sql import functions as F

    from quillspark.operators import segment

    text = "Before\n1.1 Scope of it\nEveryone who works here.\n12 Page\n Section 2.1: Duties\nThe owner keeps the list.\n\nA12 Asset list\nAll assets are listed.\n3. Title alone\n4.1 Page 3 of these"
    docs = spark.createDataFrame([(1, text), (2, "no heading at all " * 4), (3, "short"), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n, r.id, r.title, r.text) for r in segment.numbered_sections(docs, "doc_id", F.col("text")).collect())
    assert got == [
        (1, 1, "1.1", "Scope of it", "1.1 Scope of it\nEveryone who works here.\n12 Page"),
        (1, 2, "2.1", "Duties", "Section 2.1: Duties\nThe owner keeps the list."),
        (1, 3, "A12", "Asset list", "A12 Asset list\nAll assets are listed.\n3. Title alone\n4.1 Page 3 of these"),
        (2, 1, "1", "Full Document", ("no heading at all " * 4).strip()),
    ]
