"""Beyond the source, which has no streams: windowed counts of an event stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, files: int = 8) -> DataFrame:
    """A stream over a folder of Parquet event files."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and sum of values per window and event type; works on streams and tables alike."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")
