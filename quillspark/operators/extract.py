"""Extraction from grids, control bodies and page layout (W14, X9, X12, X13): expressions and windows per document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.segment import nested_list

# The lines that open a list of criteria.
CRITERIA_OPENERS = [r"The policy shall\s*:", r"The healthcare entity shall\s*:"]
NUMBERED, LETTERED = r"^\d+[.)]\s", r"^[a-z][.)]\s"


def grid_records(tables: DataFrame, keys: list[str], rows: Column, fields: dict[str, list[str]], required: list[str]) -> DataFrame:
    """(keys, n, fields): the records of grid tables (array of rows of cells).

    A field's column is the first one whose header holds any of its words; without one, or past a short row's end, its
    value is empty, as for a null cell. Tables of under two rows, and those whose header has none of the required
    phrases, give nothing.
    """
    holds = lambda cell, words: reduce(lambda a, b: a | b, (F.contains(cell, F.lit(w.lower())) for w in words))
    header = F.transform(F.element_at("_rows", 1), lambda c: F.lower(F.coalesce(c, F.lit(""))))
    kept = tables.select(*keys, rows.alias("_rows")).where(F.size("_rows") >= 2).withColumn("_head", header).where(holds(F.array_join("_head", " "), required))
    each = kept.select(*keys, "_head", F.posexplode(F.slice("_rows", F.lit(2), F.size("_rows") - 1)).alias("n", "_row"))

    def value(words):
        place = F.array_position(F.transform("_head", lambda c: holds(c, words)), F.lit(True)).cast("int")
        return F.trim(F.coalesce(F.when(place > 0, F.get("_row", place - 1)), F.lit("")))

    return each.select(*keys, (F.col("n") + 1).alias("n"), *(value(w).alias(f) for f, w in fields.items()))


def description_and_criteria(title: Column, body: Column, openers: list[str] | None = None) -> Column:
    """struct<description, criteria> of a control's title and body lines.

    A title that is a sentence with "shall" is the description; lines after it continue it until one ends with a full
    stop or a list begins. Without such a title the description is the body's first long sentence with "shall", else the
    body's start up to the list. The criteria are the numbered and lettered lines from there. Null counts as empty.
    """
    heads = "|".join(openers or CRITERIA_OPENERS)
    head, text = F.trim(F.coalesce(title, F.lit(""))), F.coalesce(body, F.lit(""))
    sentence = (F.char_length(head) > 30) & F.contains(F.lower(head), F.lit("shall"))
    opens = lambda line: line.rlike(rf"(?i)^(?:\d+[.)]\s|{heads})")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    state = F.struct(F.when(sentence, head).otherwise("").alias("d"), (sentence & ~F.endswith(head, F.lit("."))).alias("open"), F.lit("").alias("intro"), F.lit("").alias("list"), F.lit(False).alias("listed"))

    def step(acc, line):
        listed = acc["listed"] | opens(line)
        joins = acc["open"] & ~listed & (line != "")
        return F.struct(
            F.when(joins, F.concat_ws(" ", acc["d"], line)).otherwise(acc["d"]).alias("d"),
            (acc["open"] & ~listed & ~F.endswith(line, F.lit("."))).alias("open"),
            F.when(listed | joins, acc["intro"]).otherwise(F.trim(F.concat_ws(" ", acc["intro"], line))).alias("intro"),
            F.when(listed, F.concat_ws("\n", acc["list"], line)).otherwise(acc["list"]).alias("list"),
            listed.alias("listed"),
        )

    def finish(acc):
        first = F.get(F.filter(F.split(acc["intro"], r"(?<=\.)\s+(?=[A-Z])"), lambda s: (F.char_length(s) > 30) & F.contains(F.lower(s), F.lit("shall"))), F.lit(0))
        found = F.coalesce(*(F.nullif(x, F.lit("")) for x in (acc["d"], first, F.substring(acc["intro"], 1, 500), head)), F.lit(""))
        return F.struct(F.when((found == "") | F.endswith(found, F.lit(".")), found).otherwise(F.concat(found, F.lit("."))).alias("description"), nested_list(acc["list"]).alias("criteria"))

    return F.aggregate(lines, state, step, finish)


def indent_levels(blocks: DataFrame, by: list[str], x: str, step: int = 20) -> DataFrame:
    """`level`: the dense rank of a block's left edge, rounded to `step`, among its document's."""
    return blocks.withColumn("level", F.dense_rank().over(Window.partitionBy(*by).orderBy(F.round(F.col(x) / step) * step)))


def layout_items(blocks: DataFrame, by: list[str], order: str, x: str, text: str) -> DataFrame:
    """(by, item, text, sub): the numbered items of a block sequence with the lettered ones under them.

    Blocks without a number or letter continue what stands before them while they are indented deeper than the first
    block; one that isn't, after an item, ends the list. Blocks before the first item belong to none. Null or blank
    blocks are passed over.
    """
    w = Window.partitionBy(*by).orderBy(order)
    t = F.trim(text)
    some = indent_levels(blocks.where(t != ""), by, x).withColumns({"_num": t.rlike(NUMBERED), "_let": t.rlike(LETTERED)})
    some = some.withColumns({"item": F.count_if("_num").over(w), "_base": F.first("level").over(w)})
    ends = (F.col("item") > 0) & ~F.col("_num") & ~F.col("_let") & (F.col("level") <= F.col("_base"))
    inside = some.withColumn("_end", F.bool_or(ends).over(w)).where((F.col("item") > 0) & ~F.col("_end"))
    placed = inside.withColumn("_sub", F.count_if("_let").over(Window.partitionBy(*by, "item").orderBy(order)))
    body = F.when(F.col("_num") | F.col("_let"), F.regexp_replace(t, r"^(?:\d+|[a-z])[.)]\s+", "")).otherwise(t)
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda p: p["t"]), " ")
    lines = placed.groupBy(*by, "item", "_sub").agg(joined(F.struct(F.col(order).alias("o"), body.alias("t"))).alias("_t"))
    subs = F.array_sort(F.collect_list(F.when(F.col("_sub") > 0, F.struct("_sub", "_t"))))
    return lines.groupBy(*by, "item").agg(F.max(F.when(F.col("_sub") == 0, F.col("_t"))).alias("text"), F.transform(subs, lambda s: s["_t"]).alias("sub"))
