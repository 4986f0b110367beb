"""The corpus pipeline: quality rules, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._spark import free_name, materialize
from quillspark.llm.ngram_join import keep_one
from quillspark.llm.packing import pack
from quillspark.llm.repetition import keep_good
from quillspark.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. A null text has no word and is rejected; repeated rows are judged each."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (the smallest doc_id): five-word shingles, a similarity of 0.8 or more.

    Of rows that repeat an id and a text one stays; rows with a null id, and texts without words, belong to no group and stay.
    """
    return keep_one(docs, k=5, num=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; every document stays, null texts as they are. n_chars is counted anew where a text changed."""
    before = free_name(docs, "_before")
    clean = redact(docs.withColumn(before, F.col("text")))
    changed = F.col("text") != F.col(before)
    return clean.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens. A null text is the end id alone; every row is a document."""
    return pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("packing", packing)]

#: Tokens and trained models are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
