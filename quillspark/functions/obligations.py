"""Which texts oblige: the source's three word rules (F1, F2, F3), typed obligations (P19), kept and removed (F5), model or rule.

The rules' own lists are fixed values; every function takes others. Words between letters of any script count as parts of
words, as in the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words of F1 and F3, looked for as substrings.
PIPELINE_WORDS = ("shall", "must", "required", "is required", "mandatory", "shall not", "must not", "prohibited", "forbidden", "ensure", "implement", "establish", "maintain", "document")
PARSER_WORDS = ("shall", "must", "required", "is required", "should", "may not", "shall not", "must not", "prohibited", "forbidden", "mandatory")
# F2's phrases, headings that are noise at a text's start, and whole words between white space.
RULE_PHRASES = ("shall", "must", "is required to", "are required to", "should", "will ensure", "will maintain", "will implement", "will establish", "will develop", "will conduct", "will review", "will not", "must not", "shall not")
RULE_NOISE = ("table of contents", "contents", "appendix", "annex", "revision history", "document control", "version", "date", "author", "approved by", "references?", "glossary", "acronyms?", "definitions?")
RULE_WORDS = ("shall", "must", "required", "mandatory", "prohibited", "responsible", "accountable", "ensure", "maintain", "implement")
# P19's phrases and types, in order.
TYPED = (("shall", "shall"), ("must", "must"), ("is required to", "required"), ("are required to", "required"), ("mandatory", "mandatory"), ("shall not", "shall_not"), ("must not", "must_not"))


def holds_any(text: Column, words: tuple[str, ...] = PIPELINE_WORDS) -> Column:
    """any of the words, as a substring of the lower-cased text; null counts as empty."""
    return F.coalesce(F.lower(text).rlike("|".join(words)), F.lit(False))


def by_rule(text: Column, phrases: tuple[str, ...] = RULE_PHRASES, noise: tuple[str, ...] = RULE_NOISE, words: tuple[str, ...] = RULE_WORDS, least: int = 20) -> Column:
    """long enough, no noise heading at the start, and a phrase between word boundaries or a word between white space."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    listed = F.arrays_overlap(F.split(F.lower(t), r"(?U)\s+"), F.array(*map(F.lit, words)))
    heading = t.rlike(r"(?iU)^(?:" + "|".join(noise) + r")\b")
    return (F.char_length(t) >= least) & ~heading & (t.rlike(r"(?iU)\b(?:" + "|".join(phrases) + r")\b") | listed)


def typed(text: Column, kinds: tuple[tuple[str, str], ...] = TYPED, least: int = 15) -> Column:
    """array<struct<text, type>>: every sentence that ends in a full stop under every phrase that it holds, phrase by phrase.

    "shall not" comes under two types, as in the source. A sentence is what stands between full stops: one pass over the
    text, however long a sentence is.
    """
    parts = F.split(F.coalesce(text, F.lit("")), r"\.", -1)
    ended = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda s: F.concat(F.regexp_replace(s, r"(?U)^\s+", ""), F.lit(".")))
    long = F.filter(ended, lambda s: F.char_length(s) >= least)
    of = lambda phrase, kind: F.transform(F.filter(long, lambda s: s.rlike(rf"(?iU)\b{phrase}\b")), lambda s: F.struct(s.alias("text"), F.lit(kind).alias("type")))
    return F.concat(*(of(*k) for k in kinds))


def kept_and_removed(rows: DataFrame, obliges: Column) -> tuple[DataFrame, DataFrame]:
    """the rows that oblige and the others; null counts as not."""
    flag = F.coalesce(obliges, F.lit(False))
    return rows.where(flag), rows.where(~flag)


def by_model(rows: DataFrame, text: str, scorer=None, threshold: float = 0.5, out: str = "obliges") -> DataFrame:
    """a model's probability (score.Scorer) at the threshold; F2's rule where there is no model."""
    if scorer is None:
        return rows.withColumn(out, by_rule(F.col(text)))
    from quillspark.operators.score import rescore

    scored = rescore(rows.withColumn("_query", F.lit("")), "_query", text, scorer)
    return scored.withColumn(out, F.col("score") >= threshold).drop("_query", "score")
