"""The two mapping pipelines as single lazy plans (R11, R12), with the source's filter order around the top-k."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.evaluate import POSITIVE
from quillspark.operators.retrieve import bm25, ranked, retrieval_log
from quillspark.operators.score import Scorer, label_and_cut, score_found
from quillspark.sources.sinks import materialize


@dataclass(frozen=True)
class Options:
    """One candidate depth, one per-document and one global cut; thresholds always reach the labels."""

    candidates: int = 10
    per_document: int = 3
    per_query: int = 10
    full: float = 0.6
    partial: float = 0.35
    block_before: bool = False

    @classmethod
    def read(cls, settings: dict[str, str]) -> "Options":
        """Options from text (an environment, arguments): each cast to its default's type, unknown names passed over."""
        known = {f.name: f.default for f in fields(cls)}
        cast = lambda d, v: v.strip().lower() in ("1", "true", "yes") if isinstance(d, bool) else type(d)(v)
        return cls(**{k: cast(known[k], v) for k, v in settings.items() if k in known})


def control_centric(queries: DataFrame, passages: DataFrame, options: Options, *, routing: DataFrame | None = None, blocked_passages: DataFrame | None = None, blocked_pairs: DataFrame | None = None, scorer: Scorer | None = None) -> tuple[DataFrame, DataFrame]:
    """(mappings, retrieval log). queries: query_id, text (and family); passages: doc_id, passage_id, text, ordinal.

    J1, T12: with routing (doc_id, family) a document is searched for its families only; documents without routing pass
    unless no loaded document is routed, in which case nothing is mapped. Then: candidates per (query, document), rescoring,
    cut per document, blocked passages, blocked pairs, positive labels, cut per query.
    """
    corpus = passages
    if blocked_passages is not None and options.block_before:
        corpus = corpus.join(blocked_passages, "passage_id", "left_anti")
    found = bm25(corpus, queries, doc="passage_id", text=F.col("text"), query="query_id", query_text=F.col("text"), group=["doc_id"], k=options.candidates)
    if routing is not None:
        pairs = found.join(queries.select("query_id", "family"), "query_id")
        known = routing.select("doc_id").distinct()
        loaded = known.join(passages.select("doc_id").distinct(), "doc_id", "left_semi")
        routed = pairs.join(routing.select("doc_id", "family"), ["doc_id", "family"], "left_semi")
        free = pairs.join(known, "doc_id", "left_anti")
        found = routed.unionByName(free).join(loaded.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_semi").drop("family")
    found = materialize(found.drop("score", "rank"), "candidates")
    scored = score_found(found, queries, passages, "query_id", "passage_id", scorer)
    cut = label_and_cut(scored, ["query_id", "doc_id"], "passage_id", options.full, options.partial, options.per_document)
    log = retrieval_log(cut.select("query_id", "passage_id", "score"), found.join(passages.select("passage_id", "ordinal"), "passage_id").select("query_id", "passage_id", "ordinal"), "query_id", "passage_id", "ordinal")
    kept = cut
    if blocked_passages is not None:
        kept = kept.join(blocked_passages, "passage_id", "left_anti")
    if blocked_pairs is not None:
        kept = kept.join(blocked_pairs, ["query_id", "passage_id"], "left_anti")
    kept = kept.where(F.col("status").isin(POSITIVE)).drop("rank")
    return ranked(kept, ["query_id"], "score", "passage_id", options.per_query).select("query_id", "doc_id", "passage_id", "status", "score", "rank"), log


def passage_centric(passages: DataFrame, controls: DataFrame, options: Options, *, routing: DataFrame | None = None, scorer: Scorer | None = None) -> DataFrame:
    """Roles swapped: each passage searches the controls; families are filtered after the cut (T11), so fewer may stay."""
    asks = passages.select(F.col("passage_id").alias("query_id"), "text")
    found = bm25(controls, asks, doc="control_id", text=F.col("text"), query="query_id", query_text=F.col("text"), k=options.candidates)
    found = materialize(found.drop("score", "rank"), "candidates").join(controls.select("control_id", "family"), "control_id")
    cut = label_and_cut(score_found(found, controls, asks, "control_id", "query_id", scorer), ["query_id"], "control_id", options.full, options.partial, options.per_query)
    if routing is not None:
        cut = cut.join(passages.select(F.col("passage_id").alias("query_id"), "doc_id"), "query_id").join(routing, ["doc_id", "family"], "left_semi")
    return cut.where(F.col("status").isin(POSITIVE)).select(F.col("query_id").alias("passage_id"), "control_id", "status", "score", "rank")
