import random

import pytest
from pyspark.sql import functions as F

from quillspark.sources import keyed

SCHEMA = "k long, s string, v double"


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_upserts_against_a_dict(spark, tmp_path, seed):
    draw, path = random.Random(seed), f"file://{tmp_path}/t"
    table = {(k, s): draw.choice([None, float(k or 0)]) for k in [None, *range(30)] for s in ("a", None)}
    make = lambda d: spark.createDataFrame([(k, s, v) for (k, s), v in d.items()], SCHEMA)
    keyed.create(make(table), path, ["k", "s"], buckets=7)
    states = [dict(table)]
    for turn in range(3):
        fill = turn == 1
        changes = {(draw.randint(0, 40), draw.choice(["a", "b", None])): draw.choice([None, float(draw.randint(100, 200))]) for _ in range(12)}
        gone = {key: turn == 2 and draw.random() < 0.5 for key in changes}
        frame = spark.createDataFrame([(*key, v, gone[key] or None) for key, v in changes.items()], SCHEMA + ", away boolean")
        version, buckets = keyed.upsert(frame, path, fill=fill, gone="away")
        for key, v in changes.items():
            if gone[key]:
                table.pop(key, None)
            elif not (fill and table.get(key) is not None):
                table[key] = v
        states.append(dict(table))
        assert version == turn + 1 and 0 < buckets <= 7
    for version, state in enumerate(states):
        assert rows_of(keyed.read(spark, path, version)) == sorted(((k, s, v) for (k, s), v in state.items()), key=repr)
    assert rows_of(keyed.read(spark, path)) == rows_of(keyed.read(spark, path, 3))


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.range(10_000).select(F.col("id").alias("k"), F.lit("x").alias("s"), F.lit(0.0).alias("v"))
    keyed.create(rows, path, ["k"], buckets=200)
    _, before = keyed._manifest(spark, path)
    version, written = keyed.upsert(rows.where("k < 100").withColumn("v", F.lit(1.0)), path)
    _, after = keyed._manifest(spark, path)
    changed = {b for b in after["folders"] if after["folders"][b] != before["folders"][b]}
    assert version == 1 and len(changed) == written <= 100
    assert keyed.read(spark, path).groupBy().sum("v").first()[0] == 100.0
    assert keyed.upsert(rows.where("false"), path) == (1, 0)


def test_columns_conflicts_and_faults(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], SCHEMA)
    keyed.create(rows, path, ["k"], buckets=3)
    keyed.upsert(rows.where("k = 2").select("k", F.lit(5.0).alias("v")).unionByName(spark.createDataFrame([(3, 7.0)], "k long, v double")), path)
    assert rows_of(keyed.read(spark, path)) == [(1, "a", 1.0), (2, "b", 5.0), (3, None, 7.0)]
    with pytest.raises(ValueError, match="no column w"):
        keyed.upsert(rows.withColumn("w", F.lit(1)), path)
    with pytest.raises(ValueError, match="more than once"):
        keyed.upsert(rows.unionByName(rows), path)
    with pytest.raises(ValueError, match="no table"):
        keyed.read(spark, f"{path}-none")
    _, manifest = keyed._manifest(spark, path)
    with pytest.raises(keyed.Conflict):
        keyed._commit(spark, path, 1, manifest | {"folders": {}})
    assert keyed.read(spark, path).count() == 3 and keyed.versions(spark, path) == [0, 1]


def test_a_lost_race_is_merged_again(spark, tmp_path, monkeypatch):
    """Another writer makes the version between this one's reading and its commit: both changes are in the table."""
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], SCHEMA)
    keyed.create(rows, path, ["k"], buckets=2)
    commit, raced = keyed._commit, []

    def late(spark_, path_, version, manifest):
        if not raced:
            raced.append(version)
            keyed.upsert(spark_.createDataFrame([(1, "other", 9.0)], SCHEMA), path_)
        commit(spark_, path_, version, manifest)

    monkeypatch.setattr(keyed, "_commit", late)
    assert keyed.upsert(spark.createDataFrame([(2, "mine", 8.0)], SCHEMA), path)[0] == 2
    assert rows_of(keyed.read(spark, path)) == [(1, "other", 9.0), (2, "mine", 8.0)]


def test_expire_and_empty_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(k, "x", 0.0) for k in range(50)], SCHEMA)
    keyed.create(rows.where("false"), path, ["k"], buckets=4)
    assert keyed.read(spark, path).count() == 0
    for n in range(3):
        keyed.upsert(rows.withColumn("v", F.lit(float(n))), path)
    keyed.upsert(rows.withColumn("away", F.lit(True)).where("k < 49"), path, gone="away")
    want = rows_of(keyed.read(spark, path))
    assert want == [(49, "x", 2.0)]
    assert keyed.expire(spark, path, keep=2) == 3 and keyed.versions(spark, path) == [3, 4]
    assert rows_of(keyed.read(spark, path)) == want and keyed.read(spark, path, 3).count() == 50
