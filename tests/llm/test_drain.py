"""The drain of open windows, and the token store on repeated identifiers and long texts."""

import random

import numpy as np
import pytest

from quillspark.llm import packing, token_store


@pytest.mark.parametrize("seed", range(25))
def test_drain_keeps_every_id_and_pads_nothing(seed):
    rng = random.Random(seed)
    window = rng.choice([16, 64, 257])
    packer, out, want = packing.SumOfSquares(window), [], {}
    for d in range(rng.choice([0, 1, 3, 40, 300])):
        ids = np.array([rng.randrange(9) for _ in range(rng.choice([1, 3, window // 2, window, rng.randrange(1, 3 * window)]))], "<u4")
        want[d] = ids.tolist()
        out += packer.add((d, 0, len(ids), ids))
    closed = len(out)
    held = sum(len(p[3]) for windows in packer.open.values() for w in windows for p in w)
    out += packer.drain()
    assert not packer.open and not packer.count.any()
    got = {}
    for i, sequence in enumerate(out):
        size = sum(len(p[3]) for p in sequence)
        assert size == window or i >= closed and size & (size - 1) == 0
        for d, start, total, ids in sequence:
            assert total == len(want[d]) and len(ids)
            got.setdefault(d, []).append((start, ids.tolist()))
    for d, ids in want.items():
        parts, at = sorted(got[d]), 0
        for start, part in parts:
            assert start == at
            at += len(part)
        assert [x for _, part in parts for x in part] == ids
    full = sum(sum(len(p[3]) for p in s) == window for s in out[closed:])
    assert full == held // window


def test_windows_that_fit_together_stay_whole():
    packer = packing.SumOfSquares(16)
    for h, d in ((10, "a"), (6, "b"), (9, "c"), (4, "d"), (3, "e")):
        packer.open.setdefault(h, packing.deque()).append([(d, 0, h, np.zeros(h, "<u4"))])
    sequences = [sorted((d, len(ids)) for d, _, _, ids in s) for s in packer.drain()]
    assert sequences == [[("a", 10), ("b", 6)], [("c", 9), ("d", 4), ("e", 3)]]


def test_a_hot_identifier_is_spread_over_shards(spark, tmp_path):
    docs = spark.range(4000).selectExpr("case when id % 2 = 0 then 7 when id % 5 = 0 then null else id end as doc_id", "concat('text ', id % 3) as text").repartition(4)
    shards = token_store.write_tokens(docs, f"file://{tmp_path}/t", shards=8)
    assert len(shards) == 8 and max(n for _, n, _ in shards) < 1200 and sum(n for _, n, _ in shards) == 4000
    got = token_store.read_tokens(spark, f"file://{tmp_path}/t", shards).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and ids.count(7) == 2001
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4


def test_shards_follow_the_bytes(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * 200_000) for i in range(6)], "doc_id long, text string")
    shards = token_store.write_tokens(docs, f"file://{tmp_path}/t", shard_bytes=1 << 19)
    assert sum(n for _, n, _ in shards) == 6 and len(shards) == 6
    assert token_store.read_tokens(spark, f"file://{tmp_path}/t", shards).count() == 6


def test_lookup_of_wanted_identifiers(spark, tmp_path):
    docs = spark.range(500).selectExpr("id * 3 as doc_id", "concat('text ', id) as text").unionByName(spark.createDataFrame([(6, "again"), (None, "none")], "doc_id long, text string"))
    uri = f"file://{tmp_path}/t"
    shards = token_store.write_tokens(docs, uri, shards=5)
    wanted = spark.createDataFrame([(0,), (6,), (7,), (1497,), (None,), (0,)], "doc_id long")
    every = {(r.doc_id, bytes(r.ids)) for r in token_store.read_tokens(spark, uri, shards).collect()}
    for most in (1_000_000, 2):
        got = [(r.doc_id, bytes(r.ids)) for r in token_store.find_tokens(spark, uri, shards, wanted, most=most).collect()]
        assert sorted(i for i, _ in got) == [0, 6, 6, 1497] and set(got) <= every
