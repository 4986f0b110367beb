import zlib
from hashlib import sha256
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from quillspark.llm import manifest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, part string, place int, leaf string, task int, root string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """(root, siblings left and right of each node at each level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for own, place in zip(paths, at, strict=True):
            run = place // 8 * 8
            own.append((nodes[run:place], nodes[place + 1 : run + 8]))
        at = [i // 8 for i in at]
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows, lower):
    parts = []
    order = lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1]))
    for _, own in groupby(sorted(rows, key=order), key=lambda r: r[2]):
        own = list(own)
        leaves = [leaf(r[0], r[3], r[2], r[4], r[1]) for r in own]
        parts.append((own, leaves, *climb(leaves)))
    root, above = climb([p[2] for p in parts])
    out = []
    for (own, leaves, subroot, paths), top in zip(parts, above, strict=True):
        for r, x, below in zip(own, leaves, paths, strict=True):
            text = r[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if r[1] is not None and lower(r[0]) else r[1]
            node, proof = leaf(r[0], r[3], r[2], r[4], text), []
            for left, right in below + top:
                proof += left + right
                node = h(*left, node, *right)
            out.append((r[0], x, subroot, root, h(*proof), node, node == root))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z") for r in rows], COLUMNS)


def lowered(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0


def proved(docs, **options):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    forged = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower).otherwise(F.col("text"))
    found = manifest.prove(docs, forged={"text": forged}, **options)
    return sorted(((r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found.collect()), key=str)


ODD = [(None, "Null Id", "en", "s", 1), (None, "Null Id", "en", "s", 1), (7, None, "en", None, None), (7, "", "en", "", 0), (7, "A", None, "s", 3), (8, "A", None, "s", 3), (8, "A", None, "s", 3), (-5, "ÉA" * 40_000, "", "s:4", 9), (2**62, "é😀Z", "é", "s", 2), (3, "only", "zz", "s", 4)]


@pytest.mark.parametrize(("least", "most"), [(3, 65_536), (1, 65_536), (1, 20)])
def test_proofs_against_brute_force(spark, least, most):
    """One block a part; many blocks, so that upper trees have levels; and blocks that grow because few may be left."""
    rows = ODD + [(i * 7 % 1009, f"Text {i % 50}", "en" if i % 3 else "de", f"s{i % 5}", i) for i in range(700)]
    assert proved(table(spark, rows), least=least, most=most) == brute(rows, lowered)


def test_one_row_and_none(spark):
    assert proved(table(spark, ODD[-1:])) == brute(ODD[-1:], lowered)
    assert proved(table(spark, [])) == []


def test_whole_proofs_give_the_root(spark):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(100)]
    found = manifest.prove(table(spark, rows), whole=True, least=1).collect()
    for r in found:
        assert sha256(r.proof.encode()).hexdigest() == r.proof_sha256 and r.verified and r.folded_root == r.root
    assert len({r.root for r in found}) == 1 and len(found) == 100


def test_a_part_that_holds_nearly_all_rows_and_one_id_are_spread(spark):
    """Equal ids are dealt by leaf and row: no task numbers more than its share."""
    docs = spark.range(20_000).selectExpr("1L as doc_id", "'same' as text", "'en' as lang", "'s' as source", "4L as n_chars")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a table this small would be one task
    try:
        placed = manifest.numbered(docs, "doc_id", "lang", manifest.COLUMNS, {})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.place for r in placed.select("place").collect()) == list(range(20_000))
    assert max(r["count"] for r in placed.groupBy("task").count().collect()) < 0.4 * 20_000
