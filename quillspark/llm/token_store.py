"""Token ids in sorted-string-table shards, written and read again.

File format (all integers little-endian):

* Data blocks of about `BLOCK` bytes. An entry is varint(shared), varint(rest), varint(value bytes), the key's
  last `rest` bytes, the value. Keys are prefix-compressed against the entry before; every 16th entry, and each
  block's first, shares nothing. The block ends with a crc32 of its bytes.
* Bloom filter: bits, 10 per key, 7 probes of two crc-based hashes.
* Index: for each block u32 length of its last key, the key, u64 offset, u32 bytes.
* Footer, 64 bytes: u64 offset and u64 bytes of the filter, the same of the index, u64 entries, u64 ids, u32 bytes
  of an id, 4 zero bytes, the magic ``QSSTABL1``.

A key is the identifier as 8 big-endian bytes with the sign bit turned, so that bytes sort as numbers do, or
nothing for a null identifier (it sorts first). A value is the ids, 2 bytes each where the vocabulary allows.
Equal keys may repeat. Tables.get() finds a key by the filter, a binary search of the index and one block.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._spark import scratch, task
from quillspark.llm.tokens import default_tokenizer, encoded, word_ids

BLOCK, RESTART, MAGIC, FOOTER = 64 << 10, 16, b"QSSTABL1", struct.Struct("<QQQQQQI4x8s")
BITS, PROBES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        n |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return n, at


def hashes(key: bytes) -> tuple[int, int]:
    return zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1


def probes(key: bytes, bits: int) -> list[int]:
    a, b = hashes(key)
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Writes one table; keys must come in ascending order."""

    def __init__(self, out, id_bytes: int):
        self.out, self.id_bytes = out, id_bytes
        self.block, self.index = bytearray(), []
        self.hashes = array("I")  # two for each distinct key: 8 bytes a key, whatever its length
        self.at = self.n = self.ids = self.in_block = 0
        self.last = b""

    def add(self, key: bytes, value: bytes) -> None:
        if self.n and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.in_block % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        if not self.n or key != self.last:
            self.hashes.extend(hashes(key))
        self.last, self.n, self.in_block, self.ids = key, self.n + 1, self.in_block + 1, self.ids + len(value) // self.id_bytes
        if len(self.block) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.block:
            self.block += struct.pack("<I", zlib.crc32(self.block))
            self.out.write(bytes(self.block))
            self.index.append(struct.pack("<I", len(self.last)) + self.last + struct.pack("<QI", self.at, len(self.block)))
            self.at += len(self.block)
            self.block, self.in_block = bytearray(), 0

    def close(self) -> None:
        self.flush()
        bits = max(64, BITS * (len(self.hashes) // 2) + 7 & ~7)
        bloom = np.zeros(bits // 8, np.uint8)
        a, b = np.frombuffer(self.hashes, np.uint32).astype(np.int64).reshape(-1, 2).T if self.hashes else (np.empty(0, np.int64),) * 2
        for i in range(PROBES):
            at = (a + i * b) % bits
            np.bitwise_or.at(bloom, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        index = b"".join(self.index)
        self.out.write(bloom.tobytes() + index + FOOTER.pack(self.at, len(bloom), self.at + len(bloom), len(index), self.n, self.ids, self.id_bytes, MAGIC))


class Table:
    """Reads one table from a pyarrow filesystem, block by block."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.file = files.open_input_file(path)
        size = self.file.size()
        self.bloom_at, self.bloom_len, index_at, index_len, self.n, self.n_ids, self.id_bytes, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no table")
        self.dtype = np.dtype(f"<u{self.id_bytes}")
        index, at = self._at(index_at, index_len), 0
        self.last, self.where = [], []
        while at < len(index):
            (k,) = struct.unpack_from("<I", index, at)
            self.last.append(index[at + 4 : at + 4 + k])
            self.where.append(struct.unpack_from("<QI", index, at + 4 + k))
            at += 16 + k
        self.bloom = None

    def _at(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        data = self._at(*self.where[i])
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block's checksum is wrong")
        at, key, end = 0, b"", len(data) - 4
        while at < end:
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.where)):
            for key, value in self.block(i):
                yield id_of(key), np.frombuffer(value, self.dtype)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier."""
        key = key_of(doc_id)
        if self.bloom is None:
            self.bloom = self._at(self.bloom_at, self.bloom_len)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(key, 8 * len(self.bloom))):
            return []
        out, i = [], bisect_left(self.last, key)
        while i < len(self.where):
            for k, value in self.block(i):
                if k == key:
                    out.append(np.frombuffer(value, self.dtype))
            if self.last[i] != key:
                break
            i += 1
        return out


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


WRITTEN = pa.schema([("shard", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())])


def write_shards(batches, uri: str, path: str, end_id: int):
    """(doc_id, text) sorted by doc_id to a file for this partition, if it has rows, and WRITTEN. A file appears under its name only when whole."""
    import uuid

    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    files, top = opened(uri)
    files.create_dir(top, recursive=True)
    words = word_ids(path)
    end = np.array([end_id], words.dtype).tobytes()
    part = writer = out = None
    for batch in batches:
        for doc_id, ids in encoded(batch, words):
            if writer is None:
                part = f"{top}/.{shard:06d}-{uuid.uuid4().hex}"
                out = files.open_output_stream(part)
                writer = Writer(out, words.dtype.itemsize)
            writer.add(key_of(doc_id), ids.tobytes() + end)
    done: list[tuple] = []
    if writer is not None:
        writer.close()
        out.close()
        files.move(part, f"{top}/{shard:06d}.sst")
        done.append((shard, writer.n, writer.ids))
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True) if done else [[]] * 3, WRITTEN, strict=True)], schema=WRITTEN)


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def read_shards(batches, uri: str, starts: list[tuple[int, int]], dtype: str = "<u4"):
    """Rows (i) to READ: the documents of the file of shard starts[i][0], in its order, of which the first starts at starts[i][1]."""
    files, top = opened(uri)

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), READ, strict=True)], schema=READ)

    for batch in batches:
        for i in batch.column(0).to_pylist():
            shard, at = starts[i]
            rows, held = [], 0
            for doc_id, ids in Table(files, f"{top}/{shard:06d}.sst"):
                rows.append((doc_id, at, ids.astype(dtype).tobytes()))
                at += len(ids)
                held += len(ids)
                if held > 2_000_000:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)


def write_tokens(docs: DataFrame, uri: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, tokenizer: str | None = None, shards: int | None = None, shard_bytes: int = 256 << 20) -> list[tuple[int, int, int]]:
    """Encode every text and write it to table shards under uri; the shards' (number, documents, ids), in order.

    Shards are ranges of the identifier: all of shard i sorts before all of shard i + 1. There are as many as the counted
    bytes of the texts need at `shard_bytes` each, and at least the session's number of shuffle partitions (so that a
    small table is spread too), unless `shards` is given. A null or empty text is the end id alone. Null identifiers sort
    first; repeated ones are kept, in the order of their texts, and one that holds very many rows is spread over shards
    (equal ones by the row's number, where longer starts of 32 characters are equal too). An empty table writes no file.
    Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if shards is None:
        held = source.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // shard_bytes))
    # Spark's range partitioner samples the keys (a bounded number) and cuts at their quantiles.
    keyed = source.withColumn("_row", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(shards, F.asc_nulls_first("doc_id"), F.asc_nulls_first(F.substring("text", 1, 32)), F.asc("_row"))
    rows = dealt.sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")).select("doc_id", "text")
    return sorted(tuple(r) for r in rows.mapInArrow(task("token_store:write_shards", uri, tokenizer or default_tokenizer(), end_id), "shard int, docs long, ids long").collect())


def read_tokens(spark: SparkSession, uri: str, shards: list[tuple[int, int, int]]) -> DataFrame:
    """Every document of the shards: doc_id, start (ids before it in all shards), ids (little-endian unsigned 32-bit)."""
    before, starts = 0, []
    for shard, _, ids in shards:
        starts.append((shard, before))
        before += ids
    return spark.range(0, len(starts), 1, max(1, len(starts))).mapInArrow(task("token_store:read_shards", uri, starts), "doc_id long, start long, ids binary")


def last_ids(batches, uri: str):
    """Shard numbers to (shard, last): the greatest identifier of each file, null where it holds null ones only."""
    files, top = opened(uri)
    for batch in batches:
        shards = batch.column(0).to_pylist()
        lasts = [id_of(Table(files, f"{top}/{shard:06d}.sst").last[-1]) for shard in shards]
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(lasts, pa.int64())], names=["shard", "last"])


def route_rows(batches, shards: np.ndarray, lasts: np.ndarray):
    """Identifiers to (shard, doc_id) of each file whose range holds them; one that ends a file may go on in the next."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        first, stop = np.searchsorted(lasts, ids, "left"), np.minimum(np.searchsorted(lasts, ids, "right") + 1, len(lasts))
        times = np.maximum(stop - first, 0)
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        yield pa.RecordBatch.from_arrays([pa.array(shards[np.repeat(first, times) + within], pa.int32()), pa.array(np.repeat(ids, times), pa.int64())], names=["shard", "doc_id"])


def find_rows(batches, uri: str, dtype: str = "<u4"):
    """(shard, doc_id), sorted, to (doc_id, ids) of the identifiers that the files hold, each by a lookup."""
    files, top = opened(uri)
    held, table = None, None
    for batch in batches:
        found = []
        for shard, doc_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != held:
                held, table = shard, Table(files, f"{top}/{shard:06d}.sst")
            found += [(doc_id, ids.astype(dtype).tobytes()) for ids in table.get(doc_id)]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], names=["doc_id", "ids"])


def find_tokens(spark: SparkSession, uri: str, shards: list[tuple[int, int, int]], wanted: DataFrame, *, id_col: str = "doc_id", most: int = 1_000_000) -> DataFrame:
    """(doc_id, ids) of every document whose identifier is wanted: filter, index and one block a hit, no scan of the files.

    Wanted identifiers are dealt to the files whose ranges hold them, by each file's greatest identifier (16 bytes a file go
    to the tasks), and looked up there in order, those of one file in parts of about `most` at the most. No identifier passes
    the driver. Null and repeated ones count for nothing.
    """
    ids = wanted.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    if not shards:
        return spark.createDataFrame([], "doc_id long, ids binary")
    numbers = spark.createDataFrame([(n,) for n, _, _ in shards], "shard int").repartition(len(shards))
    ends = sorted((r["shard"], r["last"]) for r in numbers.mapInArrow(task("token_store:last_ids", uri), "shard int, last long").collect())
    ends = [(n, last) for n, last in ends if last is not None]  # files of null identifiers only
    bounds = np.array([n for n, _ in ends], np.int32), np.array([last for _, last in ends], np.int64)
    dealt = ids.mapInArrow(task("token_store:route_rows", *bounds), "shard int, doc_id long")
    parts = max(1, -(-ids.count() // most))
    ordered = dealt.repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).sortWithinPartitions("shard", "doc_id")
    return ordered.mapInArrow(task("token_store:find_rows", uri), "doc_id long, ids binary")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """write_tokens into a new folder of the shared ones, then read_tokens."""
    uri = scratch(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, uri, write_tokens(docs, uri, **options))
