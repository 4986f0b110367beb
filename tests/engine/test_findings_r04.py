"""What the fourth review found: a small case for each mended step."""

from collections import Counter

from pyspark.sql import functions as F

from quillspark.operators import curate


def test_pairs_of_a_key_are_many_tasks_work(spark):
    """the pairs of one key, half of them with copies of one row, are dealt to tasks in cells; before, one task made them all."""
    one = F.floor(F.col("id") / 4000)
    first = spark.range(2000).select(one.alias("k"), F.col("id").alias("x"))
    second = spark.range(2000).select(one.alias("k"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("y"))
    found = curate.met_in_blocks(first, second, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count("y").alias("known")).collect()
    assert sum(r.n for r in found) == 4_000_000 and sum(r.known for r in found) == 2_000_000
    assert max(r.n for r in found) < 3_000_000


def test_cells_meet_once(spark):
    """several cells a key on both sides give every pair as often as a join does, with nulls, copies and keys of one side."""
    first = [(f"k{i % 3}", i // 2) for i in range(90)] + [("k1", None), ("k1", None), (None, 5), ("left", 1)]
    second = [(f"k{i % 4}", i // 3) for i in range(80)] + [("k1", None), ("k2", 7), ("k2", 7), (None, 5)]
    rows = [spark.createDataFrame(r, s) for r, s in ((first, "k string, x long"), (second, "k string, y long"))]
    got = curate.met_in_blocks(*rows, "k", few=2, many=3, stretch=4)
    assert got.columns == ["k", "x", "y"]
    assert Counter(map(tuple, got.collect())) == Counter((k, x, y) for k, x in first for m, y in second if k is not None and k == m)
    assert curate.met_in_blocks(rows[0].where("k = 'left'"), rows[1], "k").count() == 0
