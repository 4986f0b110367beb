"""What the third review found: a small case for each mended step."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import curate, meeting, retrieve, search
from quillspark.plans import datasets  # noqa: F401  (registers its queries)
from quillspark.plans.queries import ORACLE, QUERIES
from quillspark.sources import readers, sinks


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL over given tables (DataFrames), which are written to a folder."""
    con = duckdb.connect()
    for table, rows in tables.items():
        rows.write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLE[name]})").fetchall()
    return sorted((tuple(r) for r in got.collect()), key=repr), sorted(want, key=repr)


def test_paragraphs_over_the_limit(spark, tmp_path):
    """one paragraph over 100,000 characters, and a second chunk that is too short to stay."""
    texts = ["a" * 100_001, "b" * 100_000, "c" * 99_990 + "\n\n" + "d" * 30, "e" * 99_970 + "\n\n" + "f" * 30, "g" * 40, "h" * 60 + "\n\nshort", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, want = both(spark, tmp_path, "x4_paragraph_chunks", documents=docs)
    assert got == want and [r[0] for r in got] == [1, 3, 5]


def test_pairs_leave_a_task_piece_by_piece(spark):
    """what a task holds at once is some products, not every pair of its shard and its queries."""
    rng = np.random.default_rng(4)
    own = pa.table({"_id": pa.array(range(3000)), "_v": pa.array(rng.normal(size=(3000, 4)).tolist())})
    parts = list(meeting.pieces(own, 400_000))
    assert sum(len(p) for p in parts) == 3000 and max(map(len, parts)) * 400_000 <= meeting.PRODUCTS
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(90, 4)))], "id long, embedding array<double>")
    asks = vectors.where("id < 40").withColumnRenamed("id", "q")
    x = np.array([r.embedding for r in vectors.orderBy("id").collect()])
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    want = {(i, j) for i in range(40) for j in range(90) if i != j and x[i] @ x[j] > 1e-6}
    for found in (retrieve.cosine(vectors, asks, doc="id", query="q", k=None, shard_rows=50, block=7), retrieve.bounded_cosine(vectors, asks, doc="id", query="q", k=None, pivots=4, sample=50, shard_rows=20)):
        assert {(r.q, r.id) for r in found.collect()} == want


def test_shards_by_their_postings(spark, monkeypatch):
    """long documents make several shards, which are of counted size in postings; the rows stay the same."""
    monkeypatch.setattr(search, "SHARD_POSTINGS", 50)
    sizes = spark.sparkContext.accumulator(0)
    meet = search.meet

    def counted(left, right, keys, work, schema):
        most = left.groupBy(*keys).count().agg({"count": "max"}).first()[0]
        sizes.add(most)
        return meet(left, right, keys, work, schema)

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 60}" for j in range(40))) for i in range(60)], "d long, t string")
    asks = spark.createDataFrame([(0, "w1 w2 w3"), (1, " ".join(f"w{j}" for j in range(60)))], "q long, t string")
    args = dict(doc="d", text=F.col("t"), query="q", query_text=F.col("t"), k=4)
    monkeypatch.setattr(search, "meet", counted)
    got = sorted(map(tuple, search.bm25(docs, asks, **args).collect()))
    assert 0 < sizes.value < 400
    monkeypatch.setattr(search, "SHARD_POSTINGS", 1_000_000)
    assert got == sorted(map(tuple, search.bm25(docs, asks, **args).collect())) and len(got) == 8


@pytest.mark.parametrize("group", [None, ["g"]])
def test_shards_are_equal(spark, monkeypatch, group):
    """Many shards differ little in size (dealt by hash, three or four shares fell to one of them)."""
    monkeypatch.setattr(search, "SHARD_POSTINGS", 500)
    sizes = []
    meet = search.meet

    def counted(left, right, keys, work, schema):
        sizes.extend(r["count"] for r in left.groupBy(*keys).count().collect())
        return meet(left, right, keys, work, schema)

    monkeypatch.setattr(search, "meet", counted)
    docs = spark.createDataFrame([(i % 7 if i % 2 else i // 30, i, " ".join(f"w{(i * j) % 97}" for j in range(1, 9))) for i in range(1, 3001)], "g long, d long, t string")
    asks = spark.createDataFrame([(0, "w1 w2 w3"), (1, " ".join(f"w{j}" for j in range(97)))], "q long, t string")
    args = dict(doc="d", text=F.col("t"), query="q", query_text=F.col("t"), group=group, k=3)
    got = sorted(map(tuple, search.bm25(docs, asks, **args).collect()))
    assert len(sizes) > 40 and max(sizes) < 2 * 500
    monkeypatch.setattr(search, "SHARD_POSTINGS", 1_000_000)
    assert got == sorted(map(tuple, search.bm25(docs, asks, **args).collect()))


def test_rows_of_parents_written_small(spark, tmp_path):
    """all pairs of children and parents, with nulls and copies, in a file of a fraction of a byte a pair."""
    rows = [(i, i % 2) for i in range(2000)] + [(7, 1), (None, 1), (3, None)]
    got, want = both(spark, tmp_path / "few", "j21_parents", customer=spark.createDataFrame(rows[1700:], "c_custkey long, c_nationkey long"))
    assert got == want and len(got) > 40_000
    spark.createDataFrame(rows[:2000], "c_custkey long, c_nationkey long").write.parquet(str(tmp_path / "many" / "customer.parquet"))
    QUERIES["j21_parents"](spark, str(tmp_path / "many")).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 2_000_000


def test_copies_make_no_candidates(spark, monkeypatch):
    """owners with equal sets meet as one class; their pairs are in the result, not among the candidates."""
    names = []
    keep = curate.materialize
    monkeypatch.setattr(curate, "materialize", lambda rows, name: names.append((name, keep(rows, name))) or names[-1][1])
    rows = [(o, f"w{i}") for o in range(40) for i in range(20)] + [(o, f"w{i}") for o in (40, 41) for i in range(1, 21)] + [(50, "x")]
    got = curate.near_duplicates(spark.createDataFrame(rows, "f long, i string"), "f", "i").collect()
    assert dict(names)["candidates"].count() == 1
    kinds = sorted((r.kind, r.shared, r.na, r.nb) for r in got)
    assert kinds == [("exact", 20, 20, 20)] * (40 * 39 // 2 + 1) + [("near", 19, 20, 20)] * 80 and all(r.a < r.b for r in got)


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    """F8: many folders are no more tasks than cores when they are listed, and of files of one name the first is moved."""
    for i in range(60):
        (tmp_path / "a" / f"k={i}").mkdir(parents=True)
        (tmp_path / "a" / f"k={i}" / f"f{i % 50}").write_text(f"{i}\n")
    spark.sparkContext.setJobGroup("F8", "listing")
    assert readers.all_files(spark, str(tmp_path / "a")).count() == 60
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("F8") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= spark.sparkContext.defaultParallelism
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    files = [str(tmp_path / "a" / f"k={i}" / f"f{i % 50}") for i in range(60)]
    assert sinks.archive(spark, files, str(tmp_path / "old")) == files[:50]
    assert (tmp_path / "old" / "f3").read_text() == "3\n"
