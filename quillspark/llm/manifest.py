"""Merkle manifest of a dataset, broadcast upper-tree variant.

Every row is a leaf: the digest of its columns. The leaves of a part (a language, say) are numbered in the order of
their ids by range partitioning and prefix sums of counts, no task and no window holding a part. Large blocks of
8^k consecutive leaves are reduced to one digest each by distributed tasks; k grows with the table, so that no more
than `most` blocks are left (and one a part). Over those the driver builds the upper trees, of each part and of the
parts, and broadcasts them: they hold the suffix path of every block. The tasks then build their blocks again,
finish each row's proof with the suffix, and fold a leaf (the row's own or a forged one) up to the root.

A node is the hex sha256 of its children's hex digests; a level is one bytes object of 64 letters a node.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._spark import broadcast_if_small, materialize, task

FAN, HEX = 8, 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK = pa.schema([("part", pa.string()), ("block", pa.int64()), ("digest", pa.binary())])
PROOF = pa.schema([("id", pa.int64()), ("part", pa.string()), ("place", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("proof", pa.string())])
PROOF_COLUMNS = "id long, part string, place long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, proof string"


def leaf_of(columns: list[Column]) -> Column:
    """The digest of a row: each value as its UTF-8 byte count, a colon and itself, a null as a dash."""

    def field(c: Column) -> Column:
        value = c.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*map(field, columns)), 256)


def digest(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def levels_above(level: bytes, most: int | None = None) -> list[bytes]:
    """A level and those above it, until one node is left; given `most`, exactly that many above it (a lone node is hashed too)."""
    out = [level]
    while len(out) <= most if most is not None else len(out[-1]) > HEX:
        below = out[-1]
        out.append(b"".join(digest(below[i : i + FAN * HEX]) for i in range(0, len(below), FAN * HEX)))
    return out


def path(levels: list[bytes], place: int) -> list[tuple[bytes, bytes]]:
    """For each level but the last: the siblings left and right of the node on the way up from `place`."""
    out = []
    for level in levels[:-1]:
        run, own = place // FAN * FAN * HEX, place * HEX
        out.append((level[run:own], level[own + HEX : run + FAN * HEX]))
        place //= FAN
    return out


class Upper:
    """What is above the blocks: a tree a part over its blocks' digests, and the tree over the parts' subroots."""

    def __init__(self, blocks: list[tuple[str | None, int, bytes]]):
        ordered = sorted(blocks, key=lambda b: (b[0] is not None, (b[0] or "").encode(), b[1]))
        self.parts = {part: levels_above(b"".join(b[2] for b in own)) for part, own in groupby(ordered, key=lambda b: b[0])}
        self.order = {part: i for i, part in enumerate(self.parts)}
        self.top = levels_above(b"".join(levels[-1] for levels in self.parts.values())) if blocks else [b""]
        self.root = self.top[-1]

    def suffix(self, part: str | None, block: int) -> list[tuple[bytes, bytes]]:
        return path(self.parts[part], block) + path(self.top, self.order[part])


def grouped(batches, names: list[str]):
    """((part, block), columns) of each block of batches that are sorted by part, block and place."""
    key, held = None, []
    for batch in batches:
        parts, blocks = batch.column("part").to_pylist(), batch.column("block").to_pylist()
        first = 0
        for own, rows in groupby(zip(parts, blocks, strict=True)):
            size = sum(1 for _ in rows)
            if held and own != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(first, size).select(names))
            first += size
    if held:
        yield key, pa.Table.from_batches(held)


def inner(table: pa.Table, block_levels: int) -> list[bytes]:
    """The levels of one block. A part that is a single block ends where one node is left."""
    many = table.column("many")[0].as_py()
    return levels_above(b"".join(table.column("leaf").to_pylist()), block_levels if many else None)


def block_digests(batches, block_levels: int):
    for (part, block), table in grouped(batches, ["leaf", "many"]):
        yield pa.RecordBatch.from_pylist([{"part": part, "block": block, "digest": inner(table, block_levels)[-1]}], schema=BLOCK)


def proofs(batches, block_levels: int, upper, whole: bool):
    """Every row's proof, its digest, and the root that its forged or own leaf folds to."""
    upper = upper.value
    root = upper.root.decode()
    for (part, block), table in grouped(batches, ["id", "place", "leaf", "forged", "many"]):
        levels, suffix = inner(table, block_levels), upper.suffix(part, block)
        above, subroot = b"".join(a + b for a, b in suffix), upper.parts[part][-1].decode()
        first = block * FAN**block_levels
        for begin in range(0, table.num_rows, 4096):
            ids, places, leaves, forged, _ = (c.to_pylist() for c in table.slice(begin, 4096).columns)
            out = []
            for place, own, other in zip(places, leaves, forged, strict=True):
                below = path(levels, place - first)
                siblings = b"".join(a + b for a, b in below) + above
                folded = other or own
                for a, b in below + suffix:
                    folded = digest(a + folded + b)
                out.append((own.decode(), subroot, root, sha256(siblings).hexdigest(), folded.decode(), siblings.decode() if whole else None))
            columns = [ids, [part] * len(ids), places, *zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PROOF, strict=True)], schema=PROOF)


def numbered(docs: DataFrame, id_col: str, part_col: str, columns, forged: dict[str, Column]) -> DataFrame:
    """(part, id, place, leaf, forged, rows, task): leaves with their place in their part, which ascends by id (nulls first).

    Rows are dealt by ranges of (part, id, leaf, row), so a part, an id or a repeated row that holds a third of the table is
    dealt to many tasks. A row's place is its place in its task, less where its part begins there, plus the part's rows
    in the tasks before.
    """
    of = {c: F.col(c) for c in columns}
    own = leaf_of(list(of.values()))
    other = leaf_of([forged.get(c, v) for c, v in of.items()])
    leaves = docs.select(F.col(part_col).cast("string").alias("part"), F.col(id_col).cast("long").alias("id"), own.alias("leaf"), other.alias("forged"))
    bare = leaves.select("part", "id", F.col("leaf").cast("binary").alias("leaf"), F.when(F.col("forged") != F.col("leaf"), F.col("forged").cast("binary")).alias("forged"))
    bare = materialize(bare.withColumn("row", F.monotonically_increasing_id()), "leaves")
    order = ["part", "id", "leaf", "row"]
    dealt = bare.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("at", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumns({"task": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))}), "dealt")
    counts = dealt.groupBy("part", "task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("part")
    before = F.sum("n").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    starts = materialize(counts.select("part", "task", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("rows")), "starts")
    starts = starts.withColumnsRenamed({"part": "_part", "task": "_task"})
    same = F.col("part").eqNullSafe(F.col("_part")) & (F.col("task") == F.col("_task"))
    placed = dealt.join(broadcast_if_small(starts, starts.count()), same)
    return placed.select("part", "id", (F.col("at") + F.col("shift")).alias("place"), "leaf", "forged", "rows", "task")


def prove(docs: DataFrame, *, id_col: str = "doc_id", part_col: str = "lang", columns=COLUMNS, forged: dict[str, Column] | None = None, whole: bool = False, least: int = 3, most: int = 65_536) -> DataFrame:
    """One row per row of docs: id, part, place, leaf, subroot, root, proof_sha256, folded_root, verified; `proof` too where whole is set.

    A leaf digests `columns` (in order; nulls have their own mark). The leaves of a part ascend by id; every eight consecutive
    nodes become one until one is left, the subroot. Subroots, by part (null first, then UTF-8 bytewise), give the root in the
    same way. proof is every sibling on the way up, level by level, left to right; proof_sha256 its digest. `forged` gives
    columns other values for the fold alone: folded_root is what the forged leaf gives with the true siblings, and verified
    says whether that is the root.

    Rows with a null id come first in their part; equal ids follow their leaves; repeated rows are leaves each; a null part
    is a part. A null or empty text has its own leaf, as has a very long one. An empty table gives an empty result. Other
    columns of docs are ignored, whatever their names. Blocks hold 8^k leaves: k is `least`, or more where more than `most`
    blocks would be left, so a task holds 64 bytes for each of n / most leaves, and the driver 64 for each block. More parts
    than `most` are refused: a part is a language, a source or a day, not a row.
    """
    leaves = materialize(numbered(docs, id_col, part_col, columns, forged or {}), "places")
    rows = leaves.count()
    levels = least
    while rows > most * FAN**levels:
        levels += 1
    blocked = leaves.withColumns({"block": F.shiftright("place", 3 * levels), "many": F.col("rows") > FAN**levels})
    ordered = blocked.repartition("part", "block").sortWithinPartitions("part", "block", "place")
    blocks = materialize(ordered.select("part", "block", "leaf", "many").mapInArrow(task("manifest:block_digests", levels), "part string, block long, digest binary"), "blocks")
    if blocks.count() > 3 * most:
        raise ValueError(f"more than {most} parts")
    upper = docs.sparkSession.sparkContext.broadcast(Upper([(r["part"], r["block"], bytes(r["digest"])) for r in blocks.collect()]))
    found = ordered.select("part", "block", "id", "place", "leaf", "forged", "many").mapInArrow(task("manifest:proofs", levels, upper, whole), PROOF_COLUMNS)
    found = found.withColumn("verified", F.col("folded_root") == F.col("root"))
    return found if whole else found.drop("proof")

