"""Retrieval: BM25, cosine, rank fusion, hybrid blend, fallback, retrieval log, neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.cosine import cells as make_cells
from quillspark.operators.cosine import search as search_cells
from quillspark.operators.meeting import batch, matrix, meet, pieces
from quillspark.operators.search import bm25, bm25_index, ranked  # noqa: F401  (R1, A24, A25 are part of this module's face)


def cosine(vectors: DataFrame, queries: DataFrame, *, doc: str, query: str, vector: str = "embedding", k: int | None = 5, by: str | None = None, epsilon: float = 1e-9, shard_rows: int = 16_384, block: int = 8_192) -> DataFrame:
    """(query, doc, score, rank): the first k positive cosines; a query isn't its own result. The query side is the stated set.

    With `by` (a column of vectors) the greatest positive score of each query and value instead: (query, by, score). With
    k None every positive pair. Rows are dealt to shards, queries to blocks; a task multiplies one of each and keeps only
    what may be among the k; pairs leave it some million products at a time. Null vectors, and pairs of different length, have no score.
    """
    n, m = vectors.count(), queries.count()
    shards, parts = max(1, -(-n // shard_rows)), max(1, -(-m // block))
    deal = lambda c, over: F.pmod(F.xxhash64(c), F.lit(over)).cast("int")
    extra = [F.col(by).alias("_by")] if by else []
    v = F.col(vector).cast("array<double>")
    base = vectors.where(v.isNotNull()).select(F.col(doc).alias("_id"), *extra, v.alias("_v"), F.size(vector).alias("_dims"), deal(doc, shards).alias("_shard"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    asks = queries.where(v.isNotNull()).select(F.col(query).alias("_id"), v.alias("_v"), F.size(vector).alias("_dims"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"), deal(query, parts).alias("_part"))
    out, kind = (by, vectors.schema[by].dataType.simpleString()) if by else (doc, vectors.schema[doc].dataType.simpleString())

    def multiply(rows: pa.Table, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        values = rows["_id"]
        if by:  # rows in the order of their value, and where each value begins
            coded = rows["_by"].combine_chunks().dictionary_encode(null_encoding="encode")
            code = coded.indices.to_numpy()
            rows, values = rows.take(pa.array(np.argsort(code, kind="stable"))), coded.dictionary
            starts = np.searchsorted(np.sort(code), np.arange(len(values)))
        x, ids = matrix(rows["_v"]), rows["_id"].to_numpy()
        size = np.sqrt((x * x).sum(axis=1))
        for part in pieces(asked, len(x)):
            y, names = matrix(part["_v"]), part["_id"].to_numpy()
            score = (y @ x.T) / (np.sqrt((y * y).sum(axis=1))[:, None] * size[None, :] + epsilon)
            score[names[:, None] == ids[None, :]] = -np.inf
            if by:
                score = np.maximum.reduceat(score, starts, axis=1)
            elif k is not None and k < score.shape[1]:  # scores are rounded later: what may tie stays
                score[score < np.partition(score, -k, axis=1)[:, -k][:, None] - 2e-6] = -np.inf
            i, j = np.nonzero(score > 0)
            yield batch({query: part["_id"].take(pa.array(i)), out: values.take(pa.array(j)), "score": pa.array(score[i, j])})

    pairs = meet(base, asks, ["_shard", "_part", "_dims"], multiply, f"`{query}` {queries.schema[query].dataType.simpleString()}, `{out}` {kind}, score double")
    if by:
        return pairs.groupBy(query, by).agg(F.round(F.max("score"), 6).alias("score")).where("score > 0")
    return ranked(pairs.withColumn("score", F.round("score", 6)).where("score > 0"), [query], "score", doc, k)


def bounded_cosine(vectors: DataFrame, queries: DataFrame, *, doc: str, query: str, vector: str = "embedding", k: int | None = 5, by: str | None = None, epsilon: float = 1e-9, **cells) -> DataFrame:
    """cosine()'s rows, by way of cells whose bounds can rule them out (operators/cosine.py): less work where vectors
    lie in clusters. Falls back to cosine() where `by` has too many values for a list of cells."""
    index = make_cells(vectors, doc=doc, vector=vector, by=by, **cells)
    if index is None:
        return cosine(vectors, queries, doc=doc, query=query, vector=vector, k=k, by=by, epsilon=epsilon)
    found, _ = search_cells(index, queries, query=query, out=by or doc, vector=vector, k=k, by=by is not None, epsilon=epsilon)
    if by:
        return found.groupBy(query, by).agg(F.max("score").alias("score"))
    return ranked(found, [query], "score", doc, k)


def fuse(a: DataFrame, b: DataFrame, keys: list[str], by: list[str], tie: str, k: int | None = None, c: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists; an empty list leaves the other's order."""
    both = a.select(*keys, F.col("rank").alias("ra")).join(b.select(*keys, F.col("rank").alias("rb")), keys, "full_outer")
    part = lambda r: F.coalesce(1.0 / (c + F.col(r)), F.lit(0.0))
    return ranked(both.select(*keys, F.round(part("ra") + part("rb"), 9).alias("score")), by, "score", tie, k)


def hybrid(a: DataFrame, b: DataFrame, keys: list[str], by: list[str], tie: str, alpha: float = 0.5, k: int = 5) -> DataFrame:
    """Each arm over its maximum, blended by alpha."""
    def scaled(x, name):
        return x.select(*keys, (F.col("score") / F.max("score").over(Window.partitionBy(*by))).alias(name))

    both = scaled(a, "sa").join(scaled(b, "sb"), keys, "full_outer")
    score = F.round(alpha * F.coalesce("sa", F.lit(0.0)) + (1 - alpha) * F.coalesce("sb", F.lit(0.0)), 6)
    return ranked(both.select(*keys, score.alias("score")), by, "score", tie, k)


def with_fallback(found: DataFrame, queries: DataFrame, corpus: DataFrame, query: str, doc: str, ordinal: str, k: int) -> DataFrame:
    """Queries without a result get the corpus's first k rows."""
    first = corpus.orderBy(ordinal, doc).limit(k).select(doc, F.row_number().over(Window.orderBy(ordinal, doc)).alias("rank"))
    missing = queries.select(query).distinct().join(found.select(query).distinct(), query, "left_anti")
    return found.select(query, doc, "rank").unionByName(missing.crossJoin(F.broadcast(first)).select(query, doc, "rank"))


def retrieval_log(rescored: DataFrame, candidates: DataFrame, query: str, doc: str, ordinal: str) -> DataFrame:
    """Rescored rows by score, then the other candidates in their order, each once."""
    first = rescored.groupBy(query, doc).agg(F.max("score").alias("score")).withColumns({"phase": F.lit(0), ordinal: F.lit(0).cast("long")})
    rest = candidates.groupBy(query, doc).agg(F.min(ordinal).cast("long").alias(ordinal)).join(rescored.select(query, doc), [query, doc], "left_anti").withColumns({"phase": F.lit(1), "score": F.lit(0.0)})
    order = Window.partitionBy(query).orderBy("phase", F.desc("score"), ordinal, doc)
    return first.unionByName(rest.select(first.columns)).select(query, doc, F.row_number().over(order).alias("rank"))


def neighbours(found: DataFrame, corpus: DataFrame, query: str, doc: str, group: str, most: int) -> DataFrame:
    """For every query up to `most` more rows of the groups that it has hit, smallest keys first."""
    hit = found.select(query, doc).join(corpus.select(doc, group), doc).groupBy(query, group).agg(F.count_distinct(doc).alias("_hits"))
    # Of a group only its first rows can count: as many as are wanted and the most that a query has hit in it.
    depth = hit.groupBy(group).agg((F.max("_hits") + most).alias("_depth"))
    most_depth = depth.agg(F.max("_depth")).first()[0] or 0
    first = corpus.select(group, doc).withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(doc))).where(F.col("_n") <= most_depth).drop("_n")
    near = hit.join(first, group).join(found.select(query, doc), [query, doc], "left_anti")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(doc))).where(F.col("rank") <= most).select(query, doc, "rank")


def search_text(key: Column, name: Column, text: Column, cut: int = 400) -> Column:
    """What a control is found by: ``id: name``, and the first `cut` characters of its text where it has one."""
    head = F.concat(key.cast("string"), F.lit(": "), F.coalesce(name, F.lit("")))
    return F.concat_ws(" ", head, F.nullif(F.substring(F.coalesce(text, F.lit("")), 1, cut), F.lit("")))


def query_text(obligation: Column, text: Column) -> Column:
    """The obligation text, else the full text."""
    return F.coalesce(F.when(F.trim(obligation) != "", obligation), text)
