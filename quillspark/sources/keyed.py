"""A keyed table with upserts: rows in buckets of their keys, each version a manifest that names a folder per bucket.

    path/manifests/000000000003.json     keys, number of buckets, schema, folder of each bucket
    path/data/<id of a write>/_bucket=7  Parquet

An upsert writes the buckets that its changes fall into anew and leaves the others' folders where they are. A version is there
once its manifest is renamed into place, so a reader has one version or the next. Earlier versions stay until expire().
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.sources.sinks import materialize


class Conflict(Exception):
    """Another writer made the version first."""


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    path, store = _path(spark, folder)
    return sorted(s.getPath().getName() for s in store.listStatus(path)) if store.exists(path) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that are kept, oldest first."""
    return [int(n[:-5]) for n in _names(spark, f"{path}/manifests") if n.endswith(".json") and n[:-5].isdigit()]


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    kept = versions(spark, path)
    if version is None and kept:
        version = kept[-1]
    if version not in kept:
        raise ValueError(f"no version {version} in {path}" if version is not None else f"no table in {path}")
    text = spark.read.text(f"{path}/manifests/{version:012d}.json", wholetext=True).first()[0]
    return version, json.loads(text)


def _commit(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
    """The manifest under a name of its own, then renamed; a version that is there already is never replaced."""
    new, store = _path(spark, f"{path}/manifests/_{uuid.uuid4().hex}")
    out = store.create(new, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    to, _ = _path(spark, f"{path}/manifests/{version:012d}.json")
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(new, to, options)
    except Py4JJavaError as fault:
        store.delete(new, False)
        if "FileAlreadyExistsException" not in fault.java_exception.toString():
            raise
        raise Conflict(f"version {version} of {path}") from fault


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in keys)), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, keys: list[str], buckets: int, touched: int) -> dict[str, str]:
    """rows in bucket folders of a new write; which folder each bucket with a row has. A bucket is one task's file."""
    spark, write = rows.sparkSession, uuid.uuid4().hex
    rows.withColumn("_bucket", _bucket(keys, buckets)).repartition(max(1, touched), "_bucket").write.partitionBy("_bucket").parquet(f"{path}/data/{write}")
    return {n.removeprefix("_bucket="): f"{write}/{n}" for n in _names(spark, f"{path}/data/{write}") if n.startswith("_bucket=")}


def _folders(spark: SparkSession, path: str, manifest: dict, folders: list[str]) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"])
    return spark.read.schema(schema).parquet(*(f"{path}/data/{f}" for f in folders)) if folders else spark.createDataFrame([], schema)


def _once(rows: DataFrame, keys: list[str], what: str) -> None:
    if not rows.groupBy(*(F.col(f"`{k}`") for k in keys)).count().where("count > 1").isEmpty():
        raise ValueError(f"{what} hold a key more than once")


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> int:
    """Version 0, one row a key (a null is a value like others). Buckets: as many as keep each within a task's memory."""
    if "_bucket" in rows.columns:
        raise ValueError("a column is named _bucket, as the folders are")
    written = materialize(rows, "keyed")
    _once(written, keys, "rows")
    folders = _write(written, path, keys, buckets, buckets)
    _commit(rows.sparkSession, path, 0, {"keys": keys, "buckets": buckets, "schema": json.loads(written.schema.json()), "folders": folders})
    return 0


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version, or a kept one."""
    _, manifest = _manifest(spark, path, version)
    return _folders(spark, path, manifest, list(manifest["folders"].values()))


def upsert(changes: DataFrame, path: str, *, fill: bool = False, gone: str | None = None, tries: int = 5) -> tuple[int, int]:
    """A new version with the changes, which are one row a key; (its number, buckets written anew).

    A change's row takes the place of its key's. With `fill` it only gives values where the row has none (J15). Columns that the
    changes lack stay as they are (null in a new row); columns that the table lacks are refused. `gone` names a boolean
    column of the changes: where it is true the key's row goes. If another writer makes the version first, the
    changes are merged into that one, up to `tries` times.
    """
    spark, written = changes.sparkSession, materialize(changes, "changes")
    for attempt in range(tries):
        version, manifest = _manifest(spark, path)
        keys, columns = manifest["keys"], [f["name"] for f in manifest["schema"]["fields"]]
        unknown = [c for c in changes.columns if c not in columns and c != gone]
        if unknown:
            raise ValueError(f"the table has no column {', '.join(unknown)}")
        if not attempt:
            _once(written, keys, "changes")
        buckets = manifest["buckets"]
        touched = sorted(str(r[0]) for r in written.select(_bucket(keys, buckets)).distinct().collect())  # at most one row a bucket
        if not touched:
            return version, 0
        folders = manifest["folders"]
        old = _folders(spark, path, manifest, [folders[b] for b in touched if b in folders])
        merged = _merge(old, written, keys, columns, fill, gone)
        kept = {b: f for b, f in folders.items() if b not in touched}
        new = _write(merged, path, keys, buckets, len(touched))
        try:
            _commit(spark, path, version + 1, manifest | {"folders": kept | new})
        except Conflict:
            if attempt + 1 == tries:
                raise
            continue
        return version + 1, len(touched)
    raise ValueError("tries is 0")


def _merge(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], fill: bool, gone: str | None) -> DataFrame:
    given = [c for c in columns if c in new.columns]
    o = old.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("o"))
    goes = F.coalesce(F.col(f"`{gone}`"), F.lit(False)) if gone else F.lit(False)
    n = new.select(F.struct(*(F.col(f"`{c}`").cast(old.schema[c].dataType).alias(c) for c in given)).alias("n"), goes.alias("goes"))
    same = [F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`")) for k in keys]
    both = o.join(n, same, "full_outer").where(~F.coalesce("goes", F.lit(False)))

    def value(c: str) -> Column:
        before = F.col(f"o.`{c}`")
        if c not in given:
            return before
        after = F.col(f"n.`{c}`")
        return F.coalesce(before, after) if fill else F.when(F.col("n").isNotNull(), after).otherwise(before)

    return both.select(*(value(c).alias(c) for c in columns))


def expire(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes all versions but the newest `keep`, and bucket folders that no kept version names; returns how many versions went.
    Run it when nobody writes or reads an old version: a folder of an unfinished upsert is named by none."""
    kept = versions(spark, path)
    old, kept = kept[: max(0, len(kept) - max(1, keep))], kept[-max(1, keep) :]
    named = {f for v in kept for f in _manifest(spark, path, v)[1]["folders"].values()}
    for v in old:
        at, store = _path(spark, f"{path}/manifests/{v:012d}.json")
        store.delete(at, False)
    for write in _names(spark, f"{path}/data"):
        for name in _names(spark, f"{path}/data/{write}"):
            if name.startswith("_bucket=") and f"{write}/{name}" not in named:
                at, store = _path(spark, f"{path}/data/{write}/{name}")
                store.delete(at, True)
    return len(old)
