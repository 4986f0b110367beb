from xml.etree import ElementTree

from pyspark.sql import Row
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import curate, evaluate, extract, rank, synthesize
from quillspark.sources import sinks


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_typed_obligations_hold_a_sentence_under_both_types(spark):
    df = spark.createDataFrame([("You shall not open the gate. Nobody may pass it here",)], "text string")
    got = df.select(T.typed_obligations(F.col("text"), {"duty": "shall", "ban": "shall not|nobody"}).alias("x")).first().x
    assert [(r.type, r.text[:6]) for r in got] == [("duty", "You sh"), ("ban", "You sh"), ("ban", "Nobody")]


def test_duplicates_lose_and_distinct_parts_stay(spark):
    parts = spark.createDataFrame(
        [("a", "a1", 1, i) for i in range(10)] + [("a", "a2", 2, i) for i in range(10)]  # duplicates; a1 and a2 equal in gold
        + [("b", "b1", 1, i) for i in range(10)] + [("b", "b2", 2, i) for i in range(9, 19)]  # one shared item of 20
        + [("c", "c1", 1, None)], "name string, file string, at int, item int")
    gold = spark.createDataFrame([(1,), (1,), (None,)], "item int")
    got = rows(curate.keep_or_archive(parts, gold, "name", "file", "item", "at"), "file", "n_gold", "n_items", "kept")
    assert got == [("a1", 1, 10, False), ("a2", 1, 10, True), ("b1", 1, 10, True), ("b2", 0, 10, True), ("c1", 0, 0, True)]
    assert curate.keep_or_archive(parts.limit(0), gold, "name", "file", "item", "at").count() == 0


def test_matching_rows_or_the_first(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, None), ("b", 2, False), ("b", 3, False)], "g string, o int, m boolean")
    assert rows(curate.matching_or_first(df, ["g"], F.col("m"), "o", 2), "g", "o") == [("a", 1), ("b", 1), ("b", 2)]


def test_counts_before_and_after(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(curate.before_and_after(a, b, ["k"]), "k", "before", "after") == [(1, 1, 0), (2, 2, 1), (3, 0, 1)]


def test_grid_needs_a_header_and_pads_short_rows(spark):
    good = [["Control Number", "Control Name", None], ["1", " One ", "x"], ["2"], [None, "Three", None]]
    df = spark.createDataFrame([Row(d=1, g=good), Row(d=2, g=[["Price", "Name"], ["1", "One"]]), Row(d=3, g=[["control name"]]), Row(d=4, g=None)], "d int, g array<array<string>>")
    got = extract.grid_records(df, ["d"], F.col("g"), {"number": ["control number"], "name": ["control name", "name"], "why": ["reason"]}, ["control number", "control name"])
    assert rows(got, "d", "n", "number", "name", "why") == [(1, 1, "1", "One", ""), (1, 2, "2", "", ""), (1, 3, "", "Three", "")]


def test_description_forms(spark):
    long = "The entity shall keep a list of all its keys"
    df = spark.createDataFrame(
        [(1, long, "and doors.\nnot this\n1. one\na. sub\n2. two"), (2, "Keys", f"Some talk. {long}. More of it\n1) one"), (3, long, None), (4, None, None), (5, "Keys", "plain words")],
        "k int, title string, body string",
    )
    got = {r.k: r.x for r in df.select("k", extract.description_and_criteria(F.col("title"), F.col("body")).alias("x")).collect()}
    assert got[1].description == long + " and doors." and [(c.text, c.sub) for c in got[1].criteria] == [("one", ["sub"]), ("two", [])]
    assert got[2].description == long + "." and [c.text for c in got[2].criteria] == ["one"]
    assert (got[3].description, got[3].criteria) == (long + ".", [])
    assert (got[4].description, got[5].description) == ("", "plain words.")


def test_layout_list_ends_at_the_margin(spark):
    blocks = [(1, 20.0, "Head"), (2, 61.0, "1. first"), (3, 79.0, "goes on"), (4, 80.0, "a) sub"), (5, 99.0, "goes on too"), (6, 60.0, "2. second"), (7, 60.0, " "), (8, 20.0, "Foot"), (9, 60.0, "3. other list")]
    df = spark.createDataFrame([(1, *b) for b in blocks], "d int, o int, x double, t string")
    got = rows(extract.layout_items(df, ["d"], "o", "x", "t"), "item", "text", "sub")
    assert got == [(1, "first goes on", ["sub goes on too"]), (2, "second", [])]


def test_coverage_and_agreement(spark):
    df = spark.createDataFrame([(["All staff shall record visits", "It shall be so"], "We RECORD everything"), ([], "x"), (["shall record"], None)], "p array<string>, t string")
    assert [r[0] for r in df.select(evaluate.obligation_coverage(F.col("p"), F.col("t"))).collect()] == [0.5, 0.0, 0.0]
    fields = spark.createDataFrame([("a", None), (" ", 1)], "a string, b int")
    assert rows(evaluate.field_coverage(fields, ["a", "b"]), "field", "filled", "share") == [("a", 1, 0.5), ("b", 1, 0.5)]
    verdicts = spark.createDataFrame([(True, True), (True, False), (False, False)], "r boolean, v boolean")
    assert rows(evaluate.judge_agreement(verdicts, F.col("r"), F.col("v")), "wrong_rate", "accuracy") == [(1.0, 0.666667)]


def test_questions_all_rejected_stay(spark):
    df = spark.createDataFrame([("a", 0.9), ("b", None), ("c", 0.1)], "q string, s double")
    assert rows(synthesize.validated(df, "s", 0.5), "q", "s", "is_validated") == [("a", 0.9, True)]
    none = synthesize.validated(df, "s", 2.0)
    assert {(r.q, r.s, r.is_validated) for r in none.collect()} == {("a", None, False), ("b", None, False), ("c", None, False)}
    assert synthesize.validated(df.limit(0), "s", 0.5).count() == 0


def test_topic_groups_lose_no_pair_twice(spark):
    hits = spark.range(500).select(F.col("id"), F.lit("keys").alias("topic"), F.lit("answer").alias("reply"))
    got = synthesize.topic_questions(hits, "id", "topic", "reply", "What of {topic}?", 4).collect()
    used = [p for r in got for p in r.passages]
    assert len(used) == len(set(used)) == 500 and {r.n for r in got} <= {2, 3, 4} and len({r.question_id for r in got}) == len(got)


def test_negatives_exist_and_are_no_positives(spark):
    said = spark.createDataFrame([(1, "x"), (1, "x"), (1, "gone"), (2, "x"), (2, None)], "k int, m string")
    got = synthesize.valid_negatives(said, "k", "m", spark.createDataFrame([("x",), ("y",)], "m string"), spark.createDataFrame([(2, "x")], "k int, m string"))
    assert rows(got, "k", "m", "status") == [(1, "x", "Not Addressed")]


def test_ranker_finds_the_feature(spark):
    data = spark.range(200).select((F.col("id") % 4).alias("q"), F.col("id").alias("d"), (F.col("id") / 200).alias("f"), F.lit(None).cast("double").alias("none"), (F.col("id") > 150).cast("double").alias("y"))
    model = rank.fit_ranker(data, ["f"], "y", trees=10)
    got = rank.learned_rank(model, data, ["f"], ["q"], "d", 3)
    assert got.count() == 12 and got.agg(F.min("d")).first()[0] > 150


def test_label_config_and_archive(spark, tmp_path):
    config = sinks.label_config({"status": ("Choices", ["Full & whole", "None"]), "note": ("TextArea", [])}, ["control", "passage"])
    root = ElementTree.fromstring(config)
    assert [c.get("value") for c in root.iter("Choice")] == ["Full & whole", "None"] and [x.get("value") for x in root.iter("Text")] == ["$control", "$passage"]
    (tmp_path / "a.json").write_text("[]")
    moved = sinks.archive(spark, [str(tmp_path / "a.json"), str(tmp_path / "gone.json")], str(tmp_path / "old"))
    assert moved == [str(tmp_path / "a.json")] and (tmp_path / "old" / "a.json").exists() and not (tmp_path / "a.json").exists()
