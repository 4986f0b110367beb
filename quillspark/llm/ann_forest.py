"""Approximate nearest neighbours by inner product: a hash-prefix forest.

Vectors are dealt to shards of about `shard_rows` rows. In each shard a tree is a sorted array of long hash
strings (signs of `bits` random projections). A query descends every tree to the longest prefixes that enough rows
share with it, and then ascends all trees together, one bit at a time; every row that a prefix brings in is compared
exactly, in double precision. The best of all shards are merged.

A query stops by its own k-th best score: a row at that angle shares a prefix of d bits with the query in a tree with
probability (1 - angle / pi) ** d, so the depth says with what probability all trees have missed it. When that falls to
1 - `recall`, the ascent ends. Close neighbours (clusters) end it after a few rows; vectors without direction in common
(uniform on a sphere) have large angles, and most of a shard is compared.

Inner products become angles by one more coordinate, sqrt(U^2 - |x|^2) with U the largest norm (0 for a query).
The stated query set meets every shard: a task builds its shard's forest once and streams the queries past it in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._spark import task


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, the same for equal rows wherever they stand."""
    return (vectors * query).sum(axis=1)


class Forest:
    def __init__(self, vectors: np.ndarray, norm: float, trees: int, bits: int, seed: int):
        self.n, dims = vectors.shape
        self.vectors, self.norm, self.trees, self.bits = vectors, norm, trees, bits
        self.planes = np.random.default_rng(seed).normal(size=(dims + 1, trees * bits))
        lift = np.sqrt(np.maximum(norm * norm - (vectors**2).sum(axis=1), 0))
        codes = np.concatenate([self.codes(vectors[i : i + 2048], lift[i : i + 2048]) for i in range(0, self.n, 2048)])
        self.order = [np.argsort(codes[:, t], kind="stable") for t in range(trees)]
        self.keys = [codes[order, t] for t, order in enumerate(self.order)]

    def codes(self, vectors: np.ndarray, lift: np.ndarray) -> np.ndarray:
        """(rows, trees): hash strings of up to 64 bits, first bit highest."""
        signs = (np.column_stack([vectors, lift]) @ self.planes > 0).reshape(len(vectors), self.trees, self.bits)
        return signs @ np.left_shift(np.uint64(1), np.arange(self.bits, dtype=np.uint64)[::-1])

    def ranges(self, codes: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end (queries, trees) of the rows that share each query's first `depth` bits."""
        step = (self.bits - depth).astype(np.uint64)
        low = codes >> step[:, None] << step[:, None]
        high = low + ((np.uint64(1) << step) - np.uint64(1))[:, None]
        begin = [np.searchsorted(keys, low[:, t]) for t, keys in enumerate(self.keys)]
        end = [np.searchsorted(keys, high[:, t], side="right") for t, keys in enumerate(self.keys)]
        return np.stack(begin, axis=1), np.stack(end, axis=1)

    def search(self, queries: np.ndarray, own: list[np.ndarray], k: int, recall: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each query the rows that may be among its k nearest, their rough scores, and how many rows were compared. own: rows left out."""
        codes, m = self.codes(queries, np.zeros(len(queries))), len(queries)
        depth, high = np.zeros(m, np.int64), np.full(m, self.bits)
        while (depth < high).any():  # each query's longest prefix that may bring in k rows
            middle = (depth + high + 1) // 2
            begin, end = self.ranges(codes, middle)
            enough = (end - begin).sum(axis=1) >= k
            depth, high = np.where(enough, middle, depth), np.where(enough, high, middle - 1)
        certain = 1 - (1 - recall) ** (1 / self.trees)
        found = [np.zeros(self.n, bool) for _ in range(m)]
        rows: list[list] = [[] for _ in range(m)]
        scores: list[list] = [[] for _ in range(m)]
        best = [np.empty(0)] * m
        last = np.zeros((m, self.trees, 2), np.int64)
        for i, at in enumerate(own):
            found[i][at] = True
        active = np.arange(m)
        while len(active):
            begin, end = self.ranges(codes[active], depth[active])
            more = []
            changed = ((end - begin) != (last[active, :, 1] - last[active, :, 0])).any(axis=1)
            for i, a, b, news in zip(active, begin.tolist(), end.tolist(), changed, strict=True):
                if news:
                    mark = np.zeros(self.n, bool)
                    for order, x, y, (u, v) in zip(self.order, a, b, last[i].tolist(), strict=True):
                        if u == v:
                            if x < y:
                                mark[order[x:y]] = True
                            continue
                        if x < u:  # ranges grow as the trees are ascended
                            mark[order[x:u]] = True
                        if v < y:
                            mark[order[v:y]] = True
                    last[i, :, 0], last[i, :, 1] = a, b
                    mark &= ~found[i]
                    new = np.flatnonzero(mark)
                    if len(new):
                        found[i] |= mark
                        rows[i].append(new)
                        scores[i].append(self.vectors[new] @ queries[i])
                        best[i] = np.concatenate([best[i], scores[i][-1]])
                        if len(best[i]) > k:
                            best[i] = np.partition(best[i], -k)[-k:]
                if depth[i] and not (len(best[i]) >= k and self.shares(best[i].min(), queries[i], depth[i]) >= certain):
                    more.append(i)
            active = np.array(more, np.int64)
            depth[active] -= 1
        for i in range(m):
            at, rough = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((rows[i], np.int64), (scores[i], np.float64)))
            compared = len(at)
            if compared > k:  # all that may tie with the k-th
                near = rough >= best[i].min() - 1e-9 * self.norm * self.norm
                at, rough = at[near], rough[near]
            yield at, rough, compared

    def shares(self, score: float, query: np.ndarray, depth: int) -> float:
        """The probability that a row of this score shares `depth` bits with the query in a tree."""
        cosine = score / max(self.norm * np.linalg.norm(query), 1e-300)
        return (1 - np.arccos(min(1.0, max(-1.0, cosine))) / np.pi) ** depth


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search_shards(batches, k: int, norm: float, trees: int, bits: int, recall: float, seed: int, block: int):
    """(shard, asks, vec_id, vector), sorted by (shard, asks), to FOUND: each query's k nearest candidates in its shard."""
    shard, base, ids, forest = None, [], [], None

    def answered(asked: np.ndarray, queries: np.ndarray):
        out: list[tuple] = []
        own = [np.flatnonzero(ids == q) for q in asked]
        for q, query, (at, _, _) in zip(asked, queries, forest.search(queries, own, k, recall), strict=True):
            score = exact(forest.vectors[at], query)
            first = np.lexsort((ids[at], -score))[:k]
            out.append((np.full(len(first), q), ids[at][first], score[first]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)

    for batch in batches:
        shards, asks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        names, column = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3)
        vectors = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 0))
        edges = np.flatnonzero((shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            if a == b:
                continue
            if shards[a] != shard:
                shard, base, ids, forest = shards[a], [], [], None
            if not asks[a]:
                base.append(vectors[a:b].copy())
                ids.append(names[a:b].copy())
                continue
            if forest is None and base:
                forest, ids = Forest(np.concatenate(base), norm, trees, bits, seed), np.concatenate(ids)
                base = []
            if forest is not None:
                for x in range(a, b, block):
                    y = min(b, x + block)
                    yield answered(names[x:y], vectors[x:y])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector): without null, empty and zero vectors and those with null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return named.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, shard_rows: int = 16_384, shard_bytes: int = 64 << 20, block: int = 256, trees: int = 24, bits: int = 48, recall: float = 0.92, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found to each row for which is_query(id column) holds.

    Every usable row is indexed; a row isn't its own candidate, nor is another row with its id. Null, empty and zero
    vectors, those with null or non-finite components, null ids, and vectors of another length than the commonest
    (the longer, of equals) take no part. Ties go to the smaller id. An empty table, or no query, gives no row.
    """
    rows = usable(vectors, id_col, vector_col).withColumn("dims", F.size("vector"))
    stats = rows.groupBy("dims").agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2"))
    top = stats.orderBy(F.desc("n"), F.desc("dims")).first()
    dims, n, norm = (top["dims"], top["n"], top["norm2"] ** 0.5) if top else (1, 0, 1.0)
    shards = max(1, -(-n // max(1, min(shard_rows, shard_bytes // (8 * dims)))))
    rows = rows.where(F.col("dims") == dims)
    base = rows.select(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "vec_id", "vector")
    asks = rows.where(is_query(F.col("vec_id"))).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "vector")
    dealt = base.unionByName(asks).repartitionById(shards, "shard").sortWithinPartitions("shard", "asks")
    found = dealt.mapInArrow(task("ann_forest:search_shards", k, norm, trees, bits, recall, seed, block), "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
