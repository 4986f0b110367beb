"""Scans: JSON arrays, keyed objects, JSON Lines, CSV, folders, id lists. Ordinals stand in for the order of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An array of objects, or one object as a single row."""
    return spark.read.schema(schema).json(path, multiLine=True)


def keyed_object(spark: SparkSession, path: str, value: str, key: str = "id") -> DataFrame:
    """An object of id to value; an array value gives a row per item with its 0-based rank."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias(key, "item"))
    return parsed.select(key, F.posexplode("item").alias("rank", "item")) if value.startswith("array") else parsed.select(key, "item.*") if value.startswith("struct") else parsed


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """S3: blank and malformed lines are dropped, or end the scan if strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def csv_table(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Columns by name as strings; a column that the file lacks has its default."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(*(F.coalesce(F.col(f"`{c}`"), F.lit(d)).alias(c) if c in raw.columns else F.lit(d).alias(c) for c, d in columns.items()))


def folder(spark: SparkSession, path: str, schema: str, glob: str = "*.json") -> DataFrame:
    """Every readable file of a folder, with its name in `file`."""
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", True).option("pathGlobFilter", glob)
    return reader.json(path, multiLine=True).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def all_files(spark: SparkSession, path: str) -> DataFrame:
    """The lines of every file below a folder. Many folders are listed by as many tasks as there are cores; Spark's own setting is a task a folder."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        return spark.read.option("recursiveFileLookup", True).text(path)
    finally:
        spark.conf.set(name, before)


def last_file_wins(rows: DataFrame, key: str, excluded: str | None = None, file: str = "file") -> DataFrame:
    """The rows of the last file (by name) of each key; files that match `excluded` don't count."""
    kept = rows.where(~F.col(file).rlike(excluded)) if excluded else rows
    last = kept.groupBy(key).agg(F.max(file).alias(file))
    return kept.join(last, [key, file])


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that exists, on whatever store it names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return path
    return None


def nested_or_flat(rows: DataFrame) -> DataFrame:
    """Control records with an inner `control` struct, or flat ones, as (control_id, name, description)."""
    inner = "control" in rows.columns
    field = lambda nested, flat: F.coalesce(*( [F.col(f"control.{nested}")] if inner else []), *([F.col(flat)] if flat in rows.columns else []), F.lit(None).cast("string"))
    return rows.select(field("id", "control_id").alias("control_id"), field("name", "control_name").alias("name"), field("description", "description").alias("description"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id a line, comments (#) and blank lines dropped."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("id")).where((F.col("id") != "") & ~F.startswith("id", F.lit("#"))).distinct().orderBy("id")


def embedded_json(text: Column, schema: str) -> Column:
    """An object written inside a string field."""
    return F.from_json(text, schema)


def binary_files(spark: SparkSession, path: str, decoder, schema: str, glob: str = "*") -> DataFrame:
    """Files decoded by a plug-in: decoder takes and gives iterators of pandas frames (path, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInPandas(decoder, schema)


def with_ordinal(rows: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """0-based ordinals by the given columns, nulls first; rows that tie in all of them come in any order.

    Ranges of the order are written to the shared folder and sorted each by itself; what moves between them is a
    count for every range.
    """
    from quillspark.sources.sinks import in_ranges, small

    ranged = in_ranges(rows, order)
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    base = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.join(small(base), "_range").withColumn(name, F.col("_before") + own).select(*rows.columns, name)


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores where the scan has fewer partitions than there are cores (a small table in one file); else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
