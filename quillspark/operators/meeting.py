"""Two tables met group by group, with results that leave their task piece by piece."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Workers get this module's functions with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: How many products of rows and queries a task holds at once.
PRODUCTS = 1 << 20


def meet(left: DataFrame, right: DataFrame, keys: list[str], work: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work(rows of left, rows of right) of each group that both have. A group's rows come to its task whole, so the caller deals them
    to groups of bounded size; what work yields goes on at once (a cogroup would hold a group's whole result)."""
    sides = [x.select(*keys, F.struct(*(c for c in x.columns if c not in keys)).alias("_s")) for x in (left, right)]
    none = [F.lit(None).cast(x.schema["_s"].dataType) for x in sides]
    both = sides[0].select(*keys, F.col("_s").alias("_l"), none[1].alias("_r")).union(sides[1].select(*keys, none[0].alias("_l"), F.col("_s").alias("_r")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        for part in batches:
            for rows, name in zip(held, ("_l", "_r"), strict=True):
                own = part.column(name).drop_null()
                if len(own):
                    rows.append(pa.RecordBatch.from_struct_array(own))
        if held[0] and held[1]:
            yield from work(*(pa.Table.from_batches(rows).combine_chunks() for rows in held))

    return both.groupBy(*keys).applyInArrow(run, schema)


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    flat = vectors.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def pieces(asked: pa.Table, rows: int) -> Iterator[pa.Table]:
    """Queries in parts that make at most PRODUCTS products with so many rows (a single query may)."""
    step = max(1, PRODUCTS // max(1, rows))
    for first in range(0, len(asked), step):
        yield asked.slice(first, step)


def batch(columns: dict) -> pa.RecordBatch:
    whole = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns.values()]
    return pa.RecordBatch.from_arrays(whole, names=list(columns))
