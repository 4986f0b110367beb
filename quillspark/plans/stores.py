"""Queries of Word files, resumable model runs, keyed tables and cosine search with bounds, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import retrieve
from quillspark.plans.coverage import place, query
from quillspark.plans.queries import COSINE
from quillspark.sources import docx, keyed, readers, sinks
from quillspark.streaming import model_runs
from quillspark.streaming.model_runs import Model

LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ordinal FROM documents)"


@query(f"WITH {LINES} SELECT doc_id, ordinal, CASE WHEN ordinal = 0 THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN ordinal = 0 THEN 1 END::BIGINT AS level, line AS text, NULL::VARCHAR AS cells FROM l UNION ALL SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0), 'table', NULL, NULL, 'field,value;source,' || coalesce(source, '') || ';n_chars,' || coalesce(n_chars::VARCHAR, '') FROM documents")
def s10_word_files(t):
    """A Word file a document (a heading, paragraphs, a table), written and read back."""
    element = lambda kind, level, text, cells: F.struct(kind.alias("kind"), level.cast("int").alias("level"), text.cast("string").alias("text"), cells.cast("array<array<string>>").alias("cells"))
    none = F.lit(None)
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: element(F.when(i == 0, "heading").otherwise("paragraph"), F.when(i == 0, 1), x, none))
    pair = lambda name, value: F.array(F.lit(name), value)
    grid = F.array(pair("field", F.lit("value")), pair("source", F.col("source")), pair("n_chars", F.col("n_chars").cast("string")))
    body = F.concat(F.coalesce(lines, F.array()), F.array(element(F.lit("table"), none, none, grid)))
    path = place(t, "s10-word")
    docx.write(readers.spread(t("documents")).select(docx.file_name(F.col("doc_id")).alias("file"), body.alias("elements")), path)
    found = docx.sound(docx.scan(t("documents").sparkSession, path))
    flat = F.array_join(F.transform("cells", lambda row: F.array_join(row, ",")), ";")
    return found.select(F.regexp_extract("file", r"^d(\d+)\.docx$", 1).cast("long").alias("doc_id"), "ordinal", "kind", F.col("level").cast("long").alias("level"), "text", flat.alias("cells"))


def _seen(name: str, answered) -> Model:
    return Model(name, lambda prompts: [f"{name} {len(p)}" if answered(p) else None for p in prompts])


@query("SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN length(text) % 3 <> 0 THEN 'first ' || length(text) WHEN length(text) % 2 = 0 THEN 'second ' || length(text) END AS reply, CASE WHEN text IS NULL THEN NULL WHEN length(text) % 3 <> 0 THEN 'first' WHEN length(text) % 2 = 0 THEN 'second' END AS model, (CASE WHEN text IS NULL THEN 0 WHEN length(text) % 3 <> 0 THEN 1 WHEN length(text) % 2 = 0 THEN 3 ELSE 4 END)::BIGINT AS tries, CASE WHEN text IS NULL THEN 'no prompt' WHEN length(text) % 6 = 3 THEN 'second: no reply' END AS error FROM documents")
def s11_model_fallback(t):
    """Two tries of a model, then two of the next (stubs that answer by the text's length)."""
    models = [_seen("first", lambda p: len(p) % 3), _seen("second", lambda p: len(p) % 2 == 0)]
    return model_runs.ask(t("documents").select("doc_id", F.col("text").alias("prompt")), models, tries=2, wait=0).drop("prompt")


@query("SELECT item_id, model || ' ' || length(text) AS reply, model, 1::BIGINT AS tries FROM (SELECT item_id, text, 'later' AS model FROM benchmark UNION ALL SELECT -1 - doc_id, text, 'first' FROM documents)")
def k7_resumed_run(t):
    """K7: a run over the documents, then one that finds them done and asks what was added since."""
    spark, path = t("benchmark").sparkSession, place(t, "k7-run")
    run = ("item_id", "long", path)
    for name, table, key in (("first", "documents", -1 - F.col("doc_id")), ("later", "benchmark", F.col("item_id"))):
        rows = t(table).select(key.cast("long").alias("item_id"), F.col("text").alias("prompt")).where("prompt is not null")
        model_runs.enqueue(rows, "item_id", path)
        model_runs.resume(spark, *run, [_seen(name, lambda p: True)], most=1, files=1)
        model_runs.resume(spark, *run, [_seen(name, lambda p: True)])
    return model_runs.replies(spark, *run).select("item_id", "reply", "model", "tries")


THREE = """a AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice::DOUBLE AS price FROM orders),
b AS (SELECT k, CASE WHEN k % 100 = 0 THEN 'X' ELSE status END AS status, CASE WHEN k % 100 = 0 THEN NULL ELSE price END AS price FROM a),
c AS (SELECT * FROM b UNION ALL SELECT -1 - c_custkey, NULL, c_acctbal::DOUBLE FROM customer),
d AS (SELECT k, status, CASE WHEN k % 100 = 0 THEN coalesce(price, 1.0) ELSE price END AS price FROM c WHERE k % 7 <> 3)"""


def _three(t) -> str:
    """Orders as a keyed table, then three upserts: changed fields, new rows, gaps filled and keys that go."""
    path = place(t, "keyed")
    orders = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("price"))
    keyed.create(orders, path, ["k"])
    keyed.upsert(orders.where("k % 100 = 0").select("k", F.lit("X").alias("status"), F.lit(None).cast("double").alias("price")), path)
    keyed.upsert(t("customer").select((-1 - F.col("c_custkey")).alias("k"), F.col("c_acctbal").cast("double").alias("price")), path)
    ends = (F.col("k") % 7 == 3).alias("ends")
    keyed.upsert(keyed.read(orders.sparkSession, path).select("k", F.when(F.col("k") % 100 == 0, 1.0).alias("price"), ends).where("ends or price is not null"), path, fill=True, gone="ends")
    return path


@query(f"WITH {THREE} SELECT k, status, round(price, 2) AS price FROM d")
def j14_keyed_upserts(t):
    """The table after three upserts."""
    path = _three(t)
    return keyed.read(t("orders").sparkSession, path).select("k", "status", F.round("price", 2).alias("price"))


@query(f"WITH {THREE} " + " UNION ALL ".join(f"SELECT {i}::BIGINT AS version, status, count(*) AS n, count(price) AS priced FROM {v} GROUP BY status" for i, v in enumerate("abcd")))
def k12_kept_versions(t):
    """What an upsert supersedes stays as a version that can be read."""
    spark, path = t("orders").sparkSession, _three(t)
    each = [keyed.read(spark, path, v).groupBy("status").agg(F.count("*").alias("n"), F.count("price").alias("priced")).withColumn("version", F.lit(v).cast("long")) for v in keyed.versions(spark, path)]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3]).select("version", "status", "n", "priced")


@query("SELECT s_suppkey::BIGINT AS s_suppkey, s_suppkey <> max(s_suppkey) OVER (PARTITION BY s_nationkey) AS moved FROM supplier")
def k12_archive(t):
    """A file a supplier; of each nation's the last stays, the others move to the archive."""
    spark, path = t("supplier").sparkSession, place(t, "k12-files")
    readers.spread(t("supplier").select("s_suppkey", F.col("s_name").alias("value"))).write.partitionBy("s_suppkey").text(path)
    newest = t("supplier").groupBy("s_nationkey").agg(F.max("s_suppkey").alias("s_suppkey"))
    old = t("supplier").join(newest, "s_suppkey", "left_anti").select(F.concat(F.lit(f"{path}/s_suppkey="), F.col("s_suppkey").cast("string")))
    sinks.archive(spark, [r[0] for r in old.toLocalIterator()], f"{path}/archive")
    file = F.input_file_name()
    there = readers.all_files(spark, path)
    return there.select(F.regexp_extract(file, r"s_suppkey=(\d+)", 1).cast("long").alias("s_suppkey"), F.contains(file, F.lit("/archive/")).alias("moved"))


def _bounded(t, **how):
    rows = t("embeddings").withColumn("family", F.col("label").cast("string"))
    return retrieve.bounded_cosine(rows, rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), doc="vec_id", query="query_id", **how)


@query(f"WITH {COSINE} SELECT query_id, vec_id, score, rank FROM d WHERE rank <= 20")
def r2_bounded_topk(t):
    """R2: the first 20 by way of cells."""
    return _bounded(t, k=20)


@query(f"WITH {COSINE} SELECT query_id, vec_id, score FROM d")
def j3_bounded_positive(t):
    """Every positive cosine by way of cells."""
    return _bounded(t, k=None).drop("rank")


@query(f"WITH {COSINE} SELECT query_id, label::VARCHAR AS family, max(score) AS score FROM d JOIN embeddings USING (vec_id) GROUP BY 1, 2")
def r17_bounded_families(t):
    """Each family's greatest cosine by way of cells of its own."""
    return _bounded(t, by="family")
