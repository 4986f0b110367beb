"""Learned ranking (R21) with pyspark.ml: scaled features, a random forest, the first k of every query."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.retrieve import ranked


def fit_ranker(rows: DataFrame, features: list[str], label: str, trees: int = 100, depth: int = 10, seed: int = 42) -> PipelineModel:
    """A forest over standardised features; rows with a null label or feature teach nothing."""
    stages = [
        VectorAssembler(inputCols=features, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True),
        RandomForestRegressor(featuresCol="_scaled", labelCol=label, predictionCol="score", numTrees=trees, maxDepth=depth, seed=seed),
    ]
    return Pipeline(stages=stages).fit(rows.dropna(subset=[*features, label]))


def learned_rank(model: PipelineModel, rows: DataFrame, features: list[str], by: list[str], item: str, k: int = 50) -> DataFrame:
    """(by, item, score, rank): null features count as 0."""
    scored = model.transform(rows.na.fill(0, features)).select(*by, item, F.round("score", 6).alias("score"))
    return ranked(scored, by, "score", item, k)
