"""Rescoring: a model behind one method, and a deterministic lexical default."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import threshold_label, tokens
from quillspark.operators.retrieve import ranked
from quillspark.sources.readers import spread


class Scorer(Protocol):
    """A model: a frame with columns query and text to one score per row. It is made once per Python worker."""

    def __call__(self, pairs: pd.DataFrame) -> pd.Series: ...


def overlap(query: Column, text: Column) -> Column:
    """The default score: the share of the query's distinct words that the text holds, to 6 places; JVM-side."""
    return shared(word_set(query), word_set(text))


def word_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def shared(query_words: Column, text_words: Column) -> Column:
    """overlap() of two texts' distinct words."""
    hits = F.size(F.array_intersect(query_words, text_words))
    return F.when(F.size(query_words) > 0, F.round(hits / F.size(query_words), 6)).otherwise(F.lit(0.0))


def score_found(found: DataFrame, queries: DataFrame, passages: DataFrame, query: str, passage: str, scorer: Scorer | None = None, text: str = "text") -> DataFrame:
    """found (query, passage, ...) with `score` of the two texts; both sides are keyed tables with a column `text`.

    By the default scorer each text that was found is cut to words once, before the join, however many pairs it is in.
    """
    of_q = spread(queries.select(query, text)).join(found.select(query).distinct(), query, "left_semi")
    of_p = spread(passages.select(passage, text)).join(found.select(passage).distinct(), passage, "left_semi")
    made = word_set(F.col(text)) if scorer is None else F.col(text)
    pairs = spread(found).join(of_q.select(query, made.alias("_q")), query).join(of_p.select(passage, made.alias("_p")), passage)
    scored = pairs.withColumn("score", shared(F.col("_q"), F.col("_p"))) if scorer is None else rescore(pairs, "_q", "_p", scorer)
    return scored.drop("_q", "_p")


def rescore(pairs: DataFrame, query_text: str, text: str, scorer: Scorer | None = None, cut: int = 512) -> DataFrame:
    """pairs with `score`: by the scorer, in Arrow batches over the first `cut` characters, or by the default over whole texts."""
    if scorer is None:
        return pairs.withColumn("score", overlap(F.col(query_text), F.col(text)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            short = pd.DataFrame({"query": frame[query_text], "text": frame[text].str.slice(0, cut)})
            yield frame.assign(score=scorer(short).astype("float64"))

    return pairs.mapInPandas(run, pairs.withColumn("score", F.lit(0.0)).schema)


def label_and_cut(scored: DataFrame, by: list[str], tie: str, full: float, partial: float, k: int) -> DataFrame:
    """Labels by the caller's thresholds, the first k of each group."""
    return ranked(scored.withColumn("status", threshold_label(F.col("score"), full, partial)), by, "score", tie, k)


def nli_label(entailment: Column, contradiction: Column | None, full: float, partial: float) -> Column:
    """With three classes a contradiction that beats the entailment is never addressed."""
    label = threshold_label(entailment, full, partial)
    return label if contradiction is None else F.when(contradiction > entailment, "Not Addressed").otherwise(label)
