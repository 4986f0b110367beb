"""Segmentation in time proportional to the lines, and the same as folds by hand."""

import random
import time

from pyspark.sql import functions as F

from quillspark.functions import obligations as O
from quillspark.operators import segment


def packed(parts, limit):
    out, now, size = [], [], 0
    for p in parts:
        if now and size + len(p) > limit:
            out.append(now)
            now, size = [], 0
        now.append(p)
        size += len(p)
    return [*out, now] if now else out


def test_many_chunks_equal_the_fold_by_hand(spark):
    rng = random.Random(2)
    texts = {d: ["p" * rng.randrange(20, 300) + str(i) for i in range(rng.randrange(1, 1_500))] for d in range(6)}
    docs = spark.createDataFrame([(d, "\n\n".join(ps)) for d, ps in texts.items()] + [(9, None), (10, "")], "d long, t string")
    got = {}
    for r in segment.paragraph_chunks(docs, "d", F.col("t"), 900).orderBy("d", "n").collect():
        got.setdefault(r.d, []).append(r.text)
    assert got == {d: [t for g in packed(ps, 900) if len(t := " ".join(g)) >= 50] for d, ps in texts.items()}
    numbers = {r.d: r.c for r in docs.select("d", segment.chunk_numbers(F.split("t", "\n\n"), 900).alias("c")).collect()}
    for d, ps in texts.items():
        assert numbers[d] == [k for k, g in enumerate(packed(ps, 900)) for _ in g]


def test_sections_and_lists_equal_the_fold_by_hand(spark):
    rng = random.Random(5)
    kinds = ["1. top {}", "a) sub {}", "staff {} shall keep records of everything that it does", "2.1 Scope of part {}", "5) Roles {}", "", "  plain words {}  "]
    lines = [rng.choice(kinds).format(i) for i in range(1_500)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, None)], "d long, t string")
    nested, want = docs.select(segment.nested_list(F.col("t")).alias("x")).first()["x"], []
    for line in map(str.strip, lines):
        if line[:3] == "1. " or line[:3] == "5) ":
            want.append([line[3:], []])
        elif line[:3] == "a) " and want:
            want[-1][1].append(line[3:])
    assert [[x["text"], x["sub"]] for x in nested] == want
    sections, at = [["", "", []]], ""
    for line in (x.strip() for x in lines if x.strip()):
        if line.startswith("2.1 "):
            at = "2.1"
            sections.append([at, line[4:], []])
        elif line[:2] in ("1.", "5)"):
            sections.append([at, line, []])
        else:
            sections[-1][2].append(line)
    got = [(r.section_id, r.section_title, r.content) for r in segment.hierarchical_passages(docs, "d", F.col("t"), O.typed).orderBy("n").collect()]
    assert got == [(i, title or "Section", " ".join(body)) for i, title, body in sections if body]


def test_one_text_of_very_many_lines(spark):
    """Time in proportion to the lines: four times as many take at most some eight times as long (a square would take sixteen)."""
    line = F.expr("case when id % 50 = 0 then concat('1.', id, ' Scope of part') when id % 9 = 0 then '1. TOP HEADING' else concat('words of line ', id) end")

    def text(n):
        rows = spark.range(n).select("id", line.alias("x"))
        docs = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "x"))), lambda r: r["x"]), "\n").alias("t")).withColumn("d", F.lit(1)).cache()
        assert docs.count() == 1
        return docs

    def took(docs, n):
        out = []
        for work in (
            lambda: segment.lines_to_passages(docs, "d", F.col("t"), least=1).count(),
            lambda: segment.chunks(docs, "d", F.col("t"), 1_000).count(),
            lambda: segment.hierarchical_passages(docs, "d", F.col("t"), lambda c: F.size(F.split(c, " "))).count(),
            lambda: docs.select(F.size(segment.nested_list(F.col("t"))).alias("n")).first()["n"],
        ):
            began = time.time()
            assert work() > n / 200
            out.append(time.time() - began)
        docs.unpersist()
        return out

    took(text(2_000), 2_000)
    less, more = took(text(20_000), 20_000), took(text(80_000), 80_000)
    assert all(b < 8 * max(a, 1) for a, b in zip(less, more, strict=True)), (less, more)
