"""Input columns named like the operators' helpers keep their values; the word class of op8's SQL; the size of op3's generated code."""

import re

import duckdb
import pytest

import corpus_pipeline
from quillspark.llm import queries, repetition, secrets, url_filter

NAMES = ["_runs", "_base", "_random", "_spans", "_before", "_best", "_bad", "_blocks", "_words", "_HIT", "key", "m"]
PLAIN = " ".join(f"w{i}" for i in range(40))


def table(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.selectExpr("*", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars", *(f"concat('{n} ', doc_id) as `{n}`" for n in NAMES))


def kept(rows):
    return {r.doc_id: [r[n] for n in NAMES] for r in rows}


WANT = {i: [f"{n} {i}" for n in NAMES] for i in (1, 2)}


@pytest.mark.parametrize("work", [secrets.scan, secrets.redact, lambda d: url_filter.judge(d, url_col="text"), repetition.keep_good])
def test_operators_keep_values(spark, work):
    docs = table(spark, [(1, PLAIN + " password=abcdefgh123 http://spam-farm.example.org/"), (2, PLAIN[3:] + " http://a.com/en")])
    out = work(docs)
    assert kept(out.collect()) == WANT and set(docs.columns) <= set(out.columns)


def test_stages_keep_values(spark):
    docs = table(spark, [(1, PLAIN + " password=abcdefgh123"), (2, PLAIN[30:] + " other words at the end of it")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and kept(out.collect()) == WANT
        docs = out
    texts = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert texts[1] == (PLAIN + " [SECRET]", len(PLAIN) + 9)
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()} == {1, 2}


def test_sql_of_op8_splits_words_at_every_white_space(spark, tmp_path):
    texts = ["\x0b".join("abcdefghijkl"), "\x0c".join("abcdefghijkl"), "\r".join("abcdefghijkl"), "a\x0bb\n\x0c\n\r\na\x0bb", "\x0b\x0c\r", "a b\tc\nd" * 5]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    said = sorted(c.sql(f"SELECT {', '.join(names)} FROM ({queries.OP8})").fetchall())
    assert said == sorted(tuple(r) for r in queries.op8_quality_rules(spark, str(tmp_path)).select(*names).collect())
    assert [r[1] for r in said] == [len(t.encode().split()) for t in texts]


def test_code_of_op3_is_compiled_whole(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 50}.com/en/") for i in range(500)], "page_id long, url string")
    plan = url_filter.judge(pages)._jdf.queryExecution()
    # Each whole stage's largest method; HotSpot compiles methods of up to 8,000 bytes, and a class file holds 64 KB.
    from py4j.java_gateway import java_import

    java_import(spark._jvm, "org.apache.spark.sql.execution.debug.package$")
    shown = getattr(spark._jvm, "org.apache.spark.sql.execution.debug.package$").__getattr__("MODULE$").codegenString(plan.executedPlan())
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown)]
    assert sizes and max(sizes) < 8000
    shown = plan.executedPlan().toString()
    assert not re.search(r"Project \[[^\n]*AS _words", shown)
