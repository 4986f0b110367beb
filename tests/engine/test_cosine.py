import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import cosine, retrieve


def clustered(n, dims, clusters, seed=1, spread=0.15):
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(clusters, dims))
    middles /= np.linalg.norm(middles, axis=1)[:, None]
    rows = middles[draw.integers(0, clusters, n)] + spread / np.sqrt(dims) * draw.normal(size=(n, dims))
    return rows * draw.uniform(0.1, 10, n)[:, None]


def frame(spark, x, families=7):
    return spark.createDataFrame([(i, f"f{i % families}", [float(a) for a in v]) for i, v in enumerate(x)], "id long, family string, embedding array<double>")


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("x", [clustered(1500, 16, 20), np.random.default_rng(2).normal(size=(1500, 16)), np.repeat(clustered(5, 16, 5), 300, axis=0)], ids=["clusters", "uniform", "copies"])
@pytest.mark.parametrize("how", [{"k": 5}, {"k": None}, {"by": "family"}], ids=["top", "all", "by"])
def test_same_rows_as_without_bounds(spark, x, how):
    rows = frame(spark, np.round(x, 3))
    asked = rows.where("id % 50 = 0").withColumnRenamed("id", "q").drop("family")
    args = {"doc": "id", "query": "q", **how}
    assert rows_of(retrieve.bounded_cosine(rows, asked, pivots=24, shard_rows=200, **args)) == rows_of(retrieve.cosine(rows, asked, **args))


@pytest.mark.parametrize("k", [10, None])
def test_few_pairs_are_multiplied_on_clusters(spark, k):
    n = 20_000
    rows = frame(spark, clustered(n, 48, 60)).repartition(8)
    asked = rows.where("id % 100 = 0").withColumnRenamed("id", "q")
    index = cosine.cells(rows, doc="id")
    _, met = cosine.search(index, asked, query="q", out="id", k=k)
    share = met.agg(F.sum("n_rows")).first()[0] / (n * n / 100)
    assert share < (0.2 if k else 0.9)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    made = [[1.0, 0.0], [0.9, 0.1], None, [0.0, 0.0], [nan, 1.0], [inf, 1.0], [1.0, 2.0, 3.0], [-1.0, 0.0], [], [None, 1.0], [1.0, 0.0], [3.0, 2.0, 1.0]]
    rows = spark.createDataFrame(list(enumerate(made)), "id long, embedding array<double>").withColumn("family", F.when(F.col("id") % 2 == 0, F.lit("even")))
    asked = rows.withColumnRenamed("id", "q").drop("family")
    top = {(r.q, r.id, r.rank) for r in retrieve.bounded_cosine(rows, asked, doc="id", query="q", k=2).collect()}
    assert top == {(0, 10, 1), (0, 1, 2), (1, 0, 1), (1, 10, 2), (10, 0, 1), (10, 1, 2), (6, 11, 1), (11, 6, 1)}
    best = {(r.q, r.family) for r in retrieve.bounded_cosine(rows, asked, doc="id", query="q", by="family").collect()}
    assert best == {(0, "even"), (0, None), (1, "even"), (10, "even"), (10, None), (6, None), (11, "even")}
    none = rows.where("false")
    assert retrieve.bounded_cosine(none, asked, doc="id", query="q").count() == 0
    assert retrieve.bounded_cosine(rows, asked.where("false"), doc="id", query="q").count() == 0


def test_too_many_values_fall_back(spark):
    rows = frame(spark, clustered(300, 8, 4), families=100)
    asked = rows.where("id % 50 = 0").withColumnRenamed("id", "q").drop("family")
    assert cosine.cells(rows, doc="id", by="family", most=50) is None
    assert rows_of(retrieve.bounded_cosine(rows, asked, doc="id", query="q", by="family", most=50)) == rows_of(retrieve.cosine(rows, asked, doc="id", query="q", by="family"))
