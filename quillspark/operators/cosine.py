"""Exact cosine search with bounds: vectors in cells round pivots, cells skipped by the triangle inequality.

A cell holds the vectors nearest to one pivot, with their least and greatest angle to it. A query at an angle t to the pivot is
at least max(0, t - greatest, least - t) from each of them, so a cell whose cosine at that angle is below what the query
has already can't add to its result. The pivots come from a sample and steer the time only; every row is in a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.meeting import batch, matrix, meet, pieces
from quillspark.sources.sinks import materialize

#: More than rounding to six places and double precision can move a score.
SLACK = 1e-5


class Cells(NamedTuple):
    rows: DataFrame  # written: _id, _by, _v, _cell, _salt
    by: list  # of each cell: the value that its rows share,
    dims: np.ndarray  # their length,
    pivot: np.ndarray  # the pivot (-1: none of that length),
    near: np.ndarray  # the least and
    far: np.ndarray  # greatest angle to it,
    count: np.ndarray  # and how many they are
    pivots: dict[int, np.ndarray]
    shard_rows: int


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def centres(sample: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """Up to n unit vectors in the midst of the sample's: spherical k-means, begun with rows that are far from those before."""
    sample = unit(sample)
    chosen, best = [0], sample @ sample[0]
    while len(chosen) < min(n, len(sample)) and best.min() < 1 - 1e-9:
        chosen.append(int(best.argmin()))
        best = np.maximum(best, sample @ sample[chosen[-1]])
    found = sample[chosen]
    for _ in range(rounds):
        nearest = (sample @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, sample)
        size = np.sqrt((sums * sums).sum(axis=1))
        found = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], found)
    return found


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector can have a positive cosine: no nulls in it, finite, and not zero throughout."""
    v = F.col(vector).cast("array<double>")
    size = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    return vectors.withColumn("_v", v).where(size.isNotNull() & (size > 0) & ~F.isnan(size) & (size < float("inf")))


def cells(vectors: DataFrame, *, doc: str, vector: str = "embedding", by: str | None = None, pivots: int = 128, sample: int = 4_096, shard_rows: int = 16_384, most: int = 65_536) -> Cells | None:
    """The vectors in cells, written to the shared folder; None where values of `by` and pivots make more than `most` cells.

    The driver gets a sample of at most `sample` vectors, and a row a cell. A cell of more than `shard_rows` rows is dealt to several tasks.
    """
    rows = usable(vectors, vector).select(F.col(doc).alias("_id"), (F.col(by) if by else F.lit(0)).alias("_by"), "_v", F.size("_v").alias("_dims"))
    n = rows.count()
    part = min(1_000_000, max(1, -(-sample * 1_500_000 // max(1, n))))
    some = [np.asarray(r[0]) for r in rows.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < part).select("_v").limit(sample).collect()]
    few = {d: centres(np.stack([v for v in some if len(v) == d]), pivots) for d in {len(v) for v in some}}

    def place(frames):
        for frame in frames:
            pivot, angle = np.full(len(frame), -1), np.full(len(frame), np.pi)
            for d, p in few.items():
                at = np.flatnonzero(frame["_dims"].to_numpy() == d)
                if len(at):
                    cosines = unit(np.stack(frame["_v"].to_numpy()[at])) @ p.T
                    pivot[at] = cosines.argmax(axis=1)
                    angle[at] = np.arccos(np.clip(cosines.max(axis=1), -1, 1))
            yield frame.assign(_pivot=pivot, _angle=angle)

    placed = materialize(rows.mapInPandas(place, rows.select("*", F.lit(0).cast("long").alias("_pivot"), F.lit(0.0).alias("_angle")).schema), "placed")
    stats = placed.groupBy("_by", "_dims", "_pivot").agg(F.min("_angle").alias("near"), F.max("_angle").alias("far"), F.count("*").alias("n"))
    listed = stats.limit(most + 1).collect()
    if len(listed) > most:
        return None
    table = placed.sparkSession.createDataFrame([(r["_by"], r["_dims"], r["_pivot"], i, -(-r["n"] // shard_rows)) for i, r in enumerate(listed)], placed.select("_by", "_dims", "_pivot", F.lit(0).alias("_cell"), F.lit(0).cast("long").alias("_salts")).schema)
    same = [placed[c].eqNullSafe(table[c]) for c in ("_by", "_dims", "_pivot")]
    dealt = placed.join(F.broadcast(table), same).select(placed["_id"], placed["_by"], "_v", "_cell", F.pmod(F.xxhash64("_id"), F.col("_salts")).cast("int").alias("_salt"))
    array = lambda c, kind: np.array([r[c] for r in listed], dtype=kind)
    return Cells(dealt, [r["_by"] for r in listed], array("_dims", int), array("_pivot", int), array("near", float), array("far", float), array("n", int), few, shard_rows)


def bounds(queries: np.ndarray, index: Cells) -> np.ndarray:
    """For each query (all of one length) and cell the greatest cosine that may be in it; -2 for a cell of another length."""
    out = np.full((len(queries), len(index.by)), -2.0)
    same = np.flatnonzero(index.dims == queries.shape[1])
    out[:, same] = 1.0
    known = same[index.pivot[same] >= 0]
    if len(known):
        angle = np.arccos(np.clip(unit(queries) @ index.pivots[queries.shape[1]].T, -1, 1))[:, index.pivot[known]]
        out[:, known] = np.cos(np.maximum(0, np.maximum(angle - index.far[known], index.near[known] - angle)))
    return out


def search(index: Cells, queries: DataFrame, *, query: str, out: str, vector: str = "embedding", k: int | None = 5, by: bool = False, epsilon: float = 1e-9, block: int = 8_192) -> tuple[DataFrame, DataFrame]:
    """((query, out, score), (query, _cell, n_rows)): what may be among the result, and the cells that each query was compared with.

    out: the rows' id, with by their value. The first cells, by bound, give a query k rows and so a least score; then
    come the cells whose bound reaches it. With k None every positive score; with by the greatest of each value.
    """
    wanted = 1 if by else k
    dims, salts = index.dims, -(-index.count // index.shard_rows)  # how many tasks a cell is dealt to
    groups = [np.flatnonzero(np.array([b == v if v is not None else b is None for b in index.by])) for v in dict.fromkeys(index.by)] if by else [np.arange(len(dims))]
    of = np.zeros(len(dims), dtype=int)
    for g, members in enumerate(groups):
        of[members] = g
    # Parts of the cells' table go to the tasks in closures: it has at most `most` rows, and the pivots.
    light = index._replace(rows=None)
    sizes = queries.sparkSession.createDataFrame([(i, int(c), int(s)) for i, (c, s) in enumerate(zip(index.count, salts, strict=True))], "_cell int, n_rows long, _salts int")
    asks = usable(queries, vector).select(F.col(query).alias("_q"), "_v")
    parts = max(1, -(-queries.count() // block))
    asks = asks.withColumn("_part", F.pmod(F.xxhash64("_q"), F.lit(parts)).cast("int"))

    def by_length(frame: pd.DataFrame):
        sizes = frame["_v"].map(len).to_numpy()
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            for first in range(0, len(at), 256):
                yield at[first : first + 256]

    def begin(frames):
        for frame in frames:
            chosen: list = [[] for _ in range(len(frame))]
            if wanted is not None:
                for at in by_length(frame):
                    bound = bounds(np.stack(frame["_v"].to_numpy()[at]), light)
                    for i, row in zip(at, bound, strict=True):
                        for members in groups:
                            order = members[np.argsort(-row[members], kind="stable")]
                            enough = int(np.searchsorted(np.cumsum(light.count[order]), wanted + 1)) + 1
                            chosen[i] += [int(c) for c in order[:enough] if row[c] > -SLACK]
            yield frame.assign(_first=pd.Series(chosen, index=frame.index, dtype=object))

    def rest(frames):
        for frame in frames:
            chosen: list = [[] for _ in range(len(frame))]
            for at in by_length(frame):
                bound = bounds(np.stack(frame["_v"].to_numpy()[at]), light)
                for i, row in zip(at, bound, strict=True):
                    least = np.zeros(len(groups))
                    known = frame["_least"].iat[i]
                    for each in known if known is not None else ():
                        least[each["g"]] = each["s"]
                    keep = row > least[of] - SLACK
                    keep[np.asarray(frame["_first"].iat[i], dtype=int)] = False
                    chosen[i] = [int(c) for c in np.flatnonzero(keep)]
            yield frame.assign(_next=pd.Series(chosen, index=frame.index, dtype=object)).drop(columns="_least")

    kinds = index.rows.schema
    result = f"`{query}` {queries.schema[query].dataType.simpleString()}, _of int, `{out}` {(kinds['_by'] if by else kinds['_id']).dataType.simpleString()}, score double"

    def multiply(rows: pa.Table, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.sort_by("_id")
        x, ids = matrix(rows["_v"]), rows["_id"].to_numpy()
        size, group = np.sqrt((x * x).sum(axis=1)), int(of[rows["_cell_"][0].as_py()])
        for part in pieces(asked, len(x)):
            y, names = matrix(part["_v"]), part["_q"].to_numpy()
            score = (y @ x.T) / (np.sqrt((y * y).sum(axis=1))[:, None] * size[None, :] + epsilon)
            score = np.floor(score * 1e6 + 0.5) / 1e6
            score[names[:, None] == ids[None, :]] = -np.inf
            if wanted is not None and wanted < score.shape[1]:  # ties go to the smaller id, which stands first
                edge = np.partition(score, -wanted, axis=1)[:, -wanted][:, None]
                spare = wanted - (score > edge).sum(axis=1)
                tied = score == edge
                score[(score < edge) | (tied & (np.cumsum(tied, axis=1) > spare[:, None]))] = -np.inf
            i, j = np.nonzero(score > 0)
            yield batch({query: part["_q"].take(pa.array(i)), "_of": pa.array(np.full(len(i), group, np.int32)), out: rows["_by" if by else "_id"].take(pa.array(j)), "score": pa.array(score[i, j])})

    def compare(pairs: DataFrame) -> DataFrame:
        asked = pairs.join(F.broadcast(sizes), "_cell").select("_q", "_v", "_part", "_cell", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
        met = pairs.select(F.col("_cell").alias("_met"), F.col("_part").alias("_of_part")).distinct()
        # A cell's rows go once to each part of the queries that asks for it.
        held = index.rows.join(met, F.col("_cell") == F.col("_met")).select(*index.rows.columns, F.col("_of_part").alias("_part"))
        keys = ["_cell", "_salt", "_part"]
        return meet(held.withColumn("_cell_", F.col("_cell")), asked, keys, multiply, result)

    begun = materialize(asks.mapInPandas(begin, asks.select("*", F.array().cast("array<int>").alias("_first")).schema), "begun")
    found = None
    start = begun.withColumn("_least", F.lit(None).cast("array<struct<g:int,s:double>>"))
    if wanted is not None:
        found = materialize(compare(begun.select("*", F.explode("_first").alias("_cell"))), "first")
        kth = F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(wanted - 1))
        least = found.groupBy(F.col(query).alias("_name"), "_of").agg(kth.alias("_s")).where("_s is not null")
        least = least.groupBy("_name").agg(F.collect_list(F.struct(F.col("_of").alias("g"), F.col("_s").alias("s"))).alias("_least"))
        start = begun.join(least, F.col("_q").eqNullSafe(F.col("_name")), "left").select(*begun.columns, "_least")
    nexts = materialize(start.mapInPandas(rest, begun.select("*", F.array().cast("array<int>").alias("_next")).schema), "next")
    more = compare(nexts.select("*", F.explode("_next").alias("_cell")))
    met = nexts.select(F.col("_q").alias(query), F.explode(F.concat("_first", "_next")).alias("_cell"))
    return (found.unionByName(more) if found is not None else more).drop("_of"), met.join(F.broadcast(sizes), "_cell").select(query, "_cell", "n_rows")
