"""Sinks. Large results are written in parallel; only bounded reports are single files."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce
from xml.etree import ElementTree
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_report(df: DataFrame, path: str) -> None:
    """K1: one JSON array in a file, for reports (bounded by their nature: families, statuses, documents of one batch)."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("j"), ",\n"), F.lit("\n]")).alias("value"))
    rows.coalesce(1).write.mode("overwrite").text(path)


def json_lines(df: DataFrame, path: str) -> None:
    """K4."""
    df.write.mode("overwrite").json(path)


def csv_with_names(df: DataFrame, names: DataFrame, key: str, columns: list[str], path: str) -> None:
    """K2: fixed columns, display names joined on the left (the first name of a key)."""
    once = names.groupBy(key).agg(*(F.first(c).alias(c) for c in names.columns if c != key))
    df.join(once, key, "left").select(columns).write.mode("overwrite").option("header", True).csv(path)


def per_document(df: DataFrame, doc: str, path: str) -> DataFrame:
    """K3: a folder per document; returns the index, largest first."""
    df.write.mode("overwrite").partitionBy(doc).json(path)
    return df.groupBy(doc).agg(F.count("*").alias("n")).orderBy(F.desc("n"), doc)


def append_run(df: DataFrame, path: str) -> None:
    """K6: a run log is only ever appended to."""
    df.write.mode("append").json(path)


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """K7: what isn't done yet."""
    return todo.join(done.select(keys).distinct(), keys, "left_anti")


def banner_text(df: DataFrame, doc: str, section: str, text: str, ordinal: str) -> DataFrame:
    """K8: a document as text, its sections under banners, in order."""
    item = F.struct(F.col(ordinal).alias("o"), F.concat(F.lit("=== "), F.coalesce(section, F.lit("")), F.lit(" ===\n"), F.coalesce(text, F.lit(""))).alias("t"))
    return df.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "\n\n").alias("text"))


def distinct_ids(df: DataFrame, *columns: str) -> DataFrame:
    """K9: the sorted distinct ids of several columns."""
    return reduce(DataFrame.union, (df.select(F.col(c).alias("id")) for c in columns)).where("id is not null").distinct().orderBy("id")


def label_config(fields: dict[str, tuple[str, list[str]]], shown: list[str]) -> str:
    """A labelling form as XML: the texts shown, then a control (its tag, its choices) for every field."""
    view = ElementTree.Element("View")
    for name in shown:
        ElementTree.SubElement(view, "Text", name=name, value=f"${name}")
    for name, (tag, choices) in fields.items():
        control = ElementTree.SubElement(view, tag, name=name, toName=shown[0])
        for choice in choices:
            ElementTree.SubElement(control, "Choice", value=choice)
    return ElementTree.tostring(view, encoding="unicode")


#: How many files archive() moves at a time.
MOVERS = 32


def archive(spark: SparkSession, files: list[str], folder: str) -> list[str]:
    """Move superseded files (curate.keep_or_archive names them) to a folder of the same store; those that aren't there
    are passed over, a file that the folder has already is kept and not moved. Returns what moved.

    A move is a change of name, which waits for the store: MOVERS of them are under way at a time. Files of one name are one
    mover's, in their order, so the first of them moves.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    target = path(folder)
    target.getFileSystem(conf).mkdirs(target)
    dealt: list[list[str]] = [[] for _ in range(MOVERS)]
    for name in files:
        dealt[crc32(name.rstrip("/").rpartition("/")[2].encode()) % MOVERS].append(name)

    def move(names: list[str]) -> list[str]:
        moved = []
        for name in names:
            file = path(name)
            store, to = file.getFileSystem(conf), path(target, file.getName())
            if store.exists(file) and not store.exists(to) and store.rename(file, to):
                moved.append(name)
        return moved

    with ThreadPoolExecutor(MOVERS) as movers:
        done = {name for moved in movers.map(move, dealt) for name in moved}
    return [name for name in dict.fromkeys(files) if name in done]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; in local mode without that setting, under /tmp/checkpoints."""
    import uuid

    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file:///tmp/checkpoints"
    path = f"{there.rstrip('/')}/quillspark/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


#: Folders that this process has named, for workspace().
WRITTEN: list[str] = []


@contextmanager
def workspace(spark: SparkSession):
    """What operators write to shared folders inside the block is deleted at its end: write their results elsewhere before that."""
    first = len(WRITTEN)
    try:
        yield
    finally:
        for name in WRITTEN[first:]:
            at = spark._jvm.org.apache.hadoop.fs.Path(name)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        del WRITTEN[first:]


def materialize(rows: DataFrame, name: str) -> DataFrame:
    """rows written as Parquet to a shared folder and read again: computed once, however often they are used."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def small(rows: DataFrame, most: int = 500_000) -> DataFrame:
    """rows (narrow and written down) with a broadcast hint where they are counted to be few; beyond that Spark's shuffled joins do the work."""
    return F.broadcast(rows) if rows.count() <= most else rows


def in_ranges(rows: DataFrame, order: list[str | Column], name: str = "_range", few: int = 100_000) -> DataFrame:
    """rows with the number of their range of the order, written down: no range holds a row that sorts before one of an earlier range.

    The input is computed once, into a written table; Spark's range partitioner samples that one. Rows that tie in all of
    the order's columns are in one range. A table counted to have at most `few` rows is one range.
    """
    written = materialize(rows, "rows")
    if written.count() <= few:
        return written.withColumn(name, F.lit(0))
    return materialize(written.repartitionByRange(*order).withColumn(name, F.spark_partition_id()), "ranges")
