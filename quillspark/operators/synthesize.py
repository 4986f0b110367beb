"""Synthetic and question rows (C8, C14 to C16, F15, P21, L11). Model replies come in as a table, so any model can be behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import keyed_hash

def filled(template: Column, values: dict[str, Column]) -> Column:
    """``{name}`` of a template by a value; a null value as nothing."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def by_hash(key: Column, options: list[str], seed: int) -> Column:
    """One of the options by a keyed hash: the same choice in every run and partitioning."""
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(keyed_hash(key, seed=seed), F.lit(len(options))) + 1).cast("int"))


def menu_text(menu: DataFrame, key: str, none: str = "(no candidates)") -> DataFrame:
    """C14: (key, menu): the offered members (route.family_menu), families with most hits first, a line each."""
    lines = F.array_sort(F.collect_list(F.struct((-F.col("hits")).alias("h"), "family", "place", "member")))
    text = F.array_join(F.transform(lines, lambda m: F.concat(F.lit("  "), m["member"])), "\n")
    return menu.groupBy(key).agg(F.coalesce(F.nullif(text, F.lit("")), F.lit(none)).alias("menu"))


def valid_negatives(proposed: DataFrame, key: str, member: str, members: DataFrame, positives: DataFrame) -> DataFrame:
    """Proposed negatives that exist and are no positive of the key, each once, with the label."""
    real = proposed.join(members.select(member).distinct(), member, "left_semi").join(positives.select(key, member), [key, member], "left_anti")
    return real.dropDuplicates([key, member]).withColumns({"status": F.lit("Not Addressed"), "is_hard_negative": F.lit(True)})


def synthetic_pairs(controls: DataFrame, key: str, text: str, templates: dict[str, list[str]], n: int = 1, seed: int = 42) -> DataFrame:
    """N rows of every label for each control; the passage is a template of the label (``{text}``), chosen by hash.

    Controls with null or blank text give nothing.
    """
    some = controls.where(F.trim(text) != "")
    each = some.select(key, text, F.explode(F.array(*map(F.lit, templates))).alias("status")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
    chosen = None
    for status, options in templates.items():
        one = by_hash(F.concat_ws(":", F.col(key).cast("string"), "copy"), options, seed)
        chosen = F.when(F.col("status") == status, one) if chosen is None else chosen.when(F.col("status") == status, one)
    slug = F.replace(F.lower("status"), F.lit(" "), F.lit("_"))
    return each.select(key, F.concat_ws("_", F.lit("synthetic"), F.col(key).cast("string"), slug, "copy").alias("passage_id"), "status", filled(chosen, {"text": F.col(text)}).alias("passage"))


def single_questions(passages: DataFrame, key: str, question: Column, reply: Column, least: int = 10) -> DataFrame:
    """(question_id, question, answer, passages, n): one question per passage; short answers give none."""
    rows = passages.select(key, question.alias("question"), reply.alias("answer")).where(F.char_length("answer") >= least)
    return rows.select(F.concat_ws("_", F.lit("q"), F.col(key).cast("string")).alias("question_id"), "question", "answer", F.array(F.col(key)).alias("passages"), F.lit(1).cast("long").alias("n"))


def topic_questions(hits: DataFrame, key: str, topic: str, reply: str, template: str, size: int, seed: int = 42) -> DataFrame:
    """The same for groups of up to `size` passages of a topic.

    Passages are dealt by a keyed hash to about one bucket per 10,000 of their topic, so a task holds a bucket and never a
    large topic; a bucket is cut into groups of `size`. Every passage is in one group, groups of one are left out.
    """
    order = keyed_hash(F.col(key), seed=seed)
    some = hits.where((F.col(reply) != "") & F.col(topic).isNotNull())
    buckets = some.groupBy(topic).agg(F.ceil(F.count("*") / 10_000).alias("_buckets"))
    dealt = some.join(buckets, topic).withColumn("_b", F.pmod(order, F.col("_buckets")))
    placed = dealt.withColumn("_g", F.floor((F.row_number().over(Window.partitionBy(topic, "_b").orderBy(order, key)) - 1) / size))
    parts = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(reply).alias("a"))))
    groups = placed.groupBy(topic, "_b", "_g").agg(parts.alias("p"), F.count("*").alias("n")).where("n >= 2")
    answer = F.array_join(F.transform("p", lambda x: F.concat(F.lit("From "), x["k"].cast("string"), F.lit(": "), x["a"])), " ")
    return groups.select(F.concat_ws("_", F.lit("q"), topic, F.col("_b").cast("string"), F.col("_g").cast("string")).alias("question_id"), filled(F.lit(template), {"topic": F.col(topic)}).alias("question"), answer.alias("answer"), F.transform("p", lambda x: x["k"]).alias("passages"), "n")


def validated(pairs: DataFrame, score: str, least: float) -> DataFrame:
    """The pairs that score high enough, flagged; if all are rejected all stay, not validated and without a score."""
    ok = F.coalesce(F.col(score) >= least, F.lit(False))
    some = pairs.agg(F.coalesce(F.bool_or(ok), F.lit(False)).alias("_any"))  # one row
    both = pairs.crossJoin(F.broadcast(some)).withColumn("is_validated", ok)
    return both.where("is_validated or not _any").withColumn(score, F.when(F.col("_any"), F.col(score))).drop("_any")
