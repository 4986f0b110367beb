"""Routing, keyword crosswalks and features."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import sentences, tokens
from quillspark.operators.retrieve import ranked
from quillspark.sources.readers import spread
from quillspark.sources.sinks import materialize, small


def keyword_hits(texts: DataFrame, key: str, text: Column, words: DataFrame, owner: str, word: str, most: int = 16_000_000, few: int = 64) -> DataFrame:
    """(key, owner, word, size) where the text holds the word, in any case.

    One scan. A dictionary of at most `few` words is an array that each row filters. A larger one becomes an automaton (a trie
    with failure links), which finds all words in one pass over a text, however many there are; it goes to the
    tasks as a broadcast of at most `most` characters, which are counted first; a still larger dictionary is met in parts.
    Null texts hold nothing; an empty word is in every other text; a word may have several owners.
    """
    listed = materialize(words.where(F.col(word).isNotNull()).select(F.col(owner).alias("o"), F.col(word).alias("w")).distinct(), "words")
    size = listed.agg(F.count("*").alias("n"), F.sum(F.char_length("w") + 8).alias("chars")).first()
    low = spread(texts.select(key, text.alias("_t"))).select(key, F.lower("_t").alias("_t"))
    if size["n"] <= few:
        kind = f"array<struct<o: {words.schema[owner].dataType.simpleString()}, w: string>>"
        table = F.from_json(F.lit(json.dumps([{"o": r["o"], "w": r["w"]} for r in listed.collect()])), kind)
        hits = low.select(key, F.explode(F.filter(table, lambda x: F.contains(F.col("_t"), F.lower(x["w"])))).alias("x"))
        return hits.select(key, F.col("x.o").alias(owner), F.col("x.w").alias(word), F.char_length("x.w").alias("size"))
    parts = max(1, -(-size["chars"] // most))
    found = []
    for i in range(parts):
        # One row a lower-case word; what owners write it how is joined to the hits.
        rows = listed.where(F.pmod(F.xxhash64(F.lower("w")), F.lit(parts)) == i).select(F.lower("w").alias("w")).distinct().collect()
        held = low.sparkSession.sparkContext.broadcast([r["w"] for r in rows])
        found.append(low.mapInArrow(held_words(held), f"`{key}` {low.schema[key].dataType.simpleString()}, _low string"))
    hits = reduce(DataFrame.unionByName, found)
    named = listed.select(F.lower("w").alias("_low"), F.col("o").alias(owner), F.col("w").alias(word), F.char_length("w").alias("size"))
    return hits.join(small(named), "_low").select(key, owner, word, "size")


def held_words(words):
    """(key, text) to (key, word) of the broadcast words that a text holds. The automaton is made once a task."""

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        made = ahocorasick.Automaton()
        for w in words.value:
            if w:
                made.add_word(w, w)
        made.make_automaton()
        always = [""] if "" in words.value else []
        for batch in batches:
            keys, rows, found = batch.column(0), [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is not None:
                    own = [*{w for _, w in made.iter(text)}, *always] if len(made) else always
                    rows += [i] * len(own)
                    found += own
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=["key", "_low"])

    return run


def title_routes(titles: DataFrame, key: str, title: Column, types: DataFrame) -> DataFrame:
    """(key, family, confidence): the longest type name in the title per family, over the longest of all."""
    best = keyword_hits(titles, key, title, types, "family", "name").groupBy(key, "family").agg(F.max("size").alias("size"))
    return best.select(key, "family", F.round(F.col("size") / F.max("size").over(Window.partitionBy(key)), 6).alias("confidence"))


def embedding_routes(scored: DataFrame, key: str, k: int = 3) -> DataFrame:
    """The first k families by score, min-max confidence (0 where all are equal)."""
    top = ranked(scored, [key], "score", "family", k)
    w = Window.partitionBy(key)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return top.select(key, "family", F.when(high == low, 0.0).otherwise(F.round((F.col("score") - low) / (high - low), 6)).alias("confidence"))


def routes(documents: DataFrame, key: str, by_title: DataFrame, by_embedding: DataFrame) -> DataFrame:
    """Title routes, else embedding routes, else a row with method none."""
    titled = by_title.withColumn("method", F.lit("title"))
    other = by_embedding.join(by_title.select(key).distinct(), key, "left_anti").withColumn("method", F.lit("embedding"))
    found = titled.unionByName(other)
    none = documents.select(key).distinct().join(found.select(key).distinct(), key, "left_anti").withColumns({"family": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "method": F.lit("none")})
    return found.unionByName(none)


def family_menu(texts: DataFrame, key: str, text: Column, words: DataFrame, members: DataFrame, positives: DataFrame, n: int = 4) -> DataFrame:
    """Up to n members of every family that has a keyword hit (of all families without one), positives left out."""
    hits = keyword_hits(texts, key, text, words, "family", "word").groupBy(key, "family").agg(F.count("*").alias("hits"))
    families = members.select("family").distinct()
    lacking = texts.select(key).join(hits.select(key).distinct(), key, "left_anti").crossJoin(families).withColumn("hits", F.lit(0).cast("long"))
    offered = hits.unionByName(lacking.select(key, "family", "hits")).join(members, "family").join(positives, [key, "member"], "left_anti")
    return offered.withColumn("place", F.row_number().over(Window.partitionBy(key, "family").orderBy("member"))).where(F.col("place") <= n)


def features(pairs: DataFrame, query: Column, text: Column) -> DataFrame:
    """Overlap, share, Jaccard, containment and length features of text pairs."""
    q, t = F.array_distinct(tokens(query)), F.array_distinct(tokens(text))
    both = F.size(F.array_intersect(q, t))
    return pairs.withColumns({"n_query": F.size(q), "n_text": F.size(t), "n_shared": both, "share": F.round(F.when(F.size(q) > 0, both / F.size(q)).otherwise(0.0), 6), "jaccard": F.round(F.when(F.size(F.array_union(q, t)) > 0, both / F.size(F.array_union(q, t))).otherwise(0.0), 6), "contains": F.contains(F.lower(text), F.lower(query)), "length": F.char_length(text)})


# The words that the source's ranker counts in a passage, and the order of its features.
REGULATORY = ("shall", "must", "required", "ensure", "implement", "control", "policy", "procedure", "risk", "security")
RANKING = ("bm25_score", "dense_similarity", "rrf_score", "control_id_in_query", "family_match", "passage_length", "word_overlap", "word_overlap_ratio", "regulatory_keyword_count")


def dense_similarity(a: Column, b: Column) -> Column:
    """The cosine of two vectors; 0 where one is null, has no length, or their sizes differ."""
    zero = F.lit(0.0)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), zero, lambda s, z: s + z)
    x, y = a.cast("array<double>"), b.cast("array<double>")
    size = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.coalesce(F.when((F.size(x) == F.size(y)) & (size > 0), dot(x, y) / size), zero)


def ranking_features(pairs: DataFrame, query: Column, text: Column, control_id: Column, family: Column, bm25: Column, dense: Column, rrf: Column) -> DataFrame:
    """Pairs with the nine features that the source ranks by; a missing score is 0. An empty control id is in every query, an empty family in none."""
    q, t = F.array_distinct(tokens(query)), F.array_distinct(tokens(text))
    both = F.size(F.array_intersect(q, t))
    asked, kind = F.lower(query), F.lower(F.coalesce(family, F.lit("")))
    held = [F.contains(F.lower(text), F.lit(w)).cast("long") for w in REGULATORY]
    made = (
        F.coalesce(bm25, F.lit(0.0)),
        F.round(F.coalesce(dense, F.lit(0.0)), 6),
        F.coalesce(rrf, F.lit(0.0)),
        F.contains(asked, F.lower(F.coalesce(control_id, F.lit("")))).cast("double"),
        ((kind != "") & F.contains(asked, kind)).cast("double"),
        F.char_length(text) / 1000.0,
        F.round(both / F.greatest(F.size(q), F.lit(1)), 6),
        F.round(both / F.greatest(F.size(t), F.lit(1)), 6),
        reduce(Column.__add__, held),
    )
    return pairs.withColumns(dict(zip(RANKING, made, strict=True)))


def extract_answer(pairs: DataFrame, keys: list[str], query: Column, text: Column, k: int = 3, prefix: int = 300) -> DataFrame:
    """The k sentences with most words of the query, in text order; the start of the text where none has any."""
    words = F.array_distinct(tokens(query))
    scored = F.transform(sentences(text), lambda s, i: F.struct((-F.size(F.array_intersect(words, F.array_distinct(tokens(s))))).alias("n"), i.alias("i"), s.alias("s")))
    best = F.slice(F.array_sort(F.filter(scored, lambda x: x["n"] < 0)), 1, k)
    joined = F.array_join(F.transform(F.array_sort(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"]), ". ")
    return pairs.select(*keys, F.when(F.size(best) > 0, joined).otherwise(F.substring(text, 1, prefix)).alias("answer"))


def contains_either(a: Column, b: Column) -> Column:
    """R23."""
    return F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a))


def crosswalk(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Every match of one framework with every match of the other, a placeholder where a side has none."""
    a = first.groupBy(key).agg(F.array_sort(F.collect_set("owner")).alias("a"))
    b = second.groupBy(key).agg(F.array_sort(F.collect_set("owner")).alias("b"))
    none = F.array(F.lit("none"))
    both = a.join(b, key, "full_outer").select(key, F.explode(F.coalesce("a", none)).alias("first"), "b")
    return both.select(key, "first", F.explode(F.coalesce("b", none)).alias("second"))
