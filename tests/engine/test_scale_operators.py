"""Prefix sums and medians over ranges, dictionaries as automata, set overlaps by rare items, on small fixtures against brute force."""

import random
from itertools import combinations
from statistics import median

import pytest
from pyspark.sql import functions as F

from quillspark.operators import curate, evaluate, route
from quillspark.sources import readers, sinks


@pytest.mark.parametrize(("by", "few"), [([], 0), (["g"], 0), ([], 100_000), (["g"], 100_000)])
@pytest.mark.parametrize("falling", [False, True])
def test_running_sums_over_ranges(spark, by, few, falling):
    rng = random.Random(3)
    rows = [(g, float(v), rng.randrange(9)) for g in ("a", "b", None) for v in rng.sample(range(-500, 500), 300 if g == "a" else 40)]
    if not by:
        rows = [(None, v, n) for v, n in {v: n for _, v, n in rows}.items()]
    counts = spark.createDataFrame(rows, "g string, v double, n long")
    got = {(r.g, r.v): r.n_upto for r in evaluate.running_sums(counts, "v", ["n"], by, falling, few=few).collect()}
    assert got == {(g, v): sum(m for h, w, m in rows if h == g and (w >= v if falling else w <= v)) for g, v, _ in rows}
    assert evaluate.running_sums(counts.limit(0), "v", ["n"], by, few=few).count() == 0


def test_the_sweep_computes_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    rows = spark.range(5_000, numPartitions=4).selectExpr("id % 700 / 7 as s", "id % 3 = 0 as y").mapInPandas(count, "s double, y boolean")
    swept = {r.threshold: (r.tp, r.fp, r.fn) for r in evaluate.threshold_sweep(rows, "s", "y").collect()}
    assert seen.value == 5_000
    data = [(i % 700 / 7, i % 3 == 0) for i in range(5_000)]
    assert swept == {t: (sum(y and s >= t for s, y in data), sum(not y and s >= t for s, y in data), sum(y and s < t for s, y in data)) for t in {s for s, _ in data}}


@pytest.mark.parametrize("few", [0, 100_000])
def test_exact_medians(spark, few):
    rng = random.Random(6)
    groups = {"odd": [rng.random() for _ in range(301)], "even": [rng.randrange(20) / 4 for _ in range(400)], "one": [7.0], "two": [1.0, 4.0], None: [3.0, 3.0, 9.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("odd", None), ("none", None)]
    got = {r.g: r["median"] for r in evaluate.medians(spark.createDataFrame(rows, "g string, v double"), "g", "v", few=few).collect()}
    assert got == {g: median(vs) for g, vs in groups.items()}
    told = {r.g: (r.n, r["median"]) for r in evaluate.distribution(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert told["none"] == (0, None) and told["two"] == (2, 2.5) and told[None] == (3, 3.0)


def test_ordinals_over_ranges(spark):
    rows = spark.range(3_000).selectExpr("id * 7919 % 3000 as v", "id")
    ranged = sinks.in_ranges(rows, ["v"], few=0)
    assert ranged.select("_range").distinct().count() >= 1 and ranged.count() == 3_000
    assert {r.v: r.ordinal for r in readers.with_ordinal(rows, ["v"]).collect()} == {v: v for v in range(3_000)}


def test_a_dictionary_of_50_000_words(spark):
    rng = random.Random(9)
    letters = "abcdeéz "
    words = sorted({"".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(60_000)})[:50_000]
    listed = [(f"o{i % 7}", w.upper() if i % 5 == 0 else w) for i, w in enumerate(words)] + [("again", words[0]), ("null", None), ("empty", "")]
    texts = [(i, "".join(rng.choices(letters + "Éq", k=rng.randrange(400)))) for i in range(30)] + [(30, None), (31, "")]
    docs, dictionary = spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame(listed, "o string, w string")
    want = {(k, o, w, len(w)) for k, t in texts if t is not None for o, w in listed if w is not None and w.lower() in t.lower()}
    for most in (16_000_000, 200_000):
        got = [tuple(r) for r in route.keyword_hits(docs, "k", F.col("t"), dictionary, "o", "w", most=most).collect()]
        assert len(got) == len(want) and set(got) == want
    small = dictionary.where("o in ('again', 'empty')")
    assert {tuple(r) for r in route.keyword_hits(docs, "k", F.col("t"), small, "o", "w", few=0).collect()} == {x for x in want if x[1] in ("again", "empty")}


def test_near_sets_against_all_pairs(spark):
    rng = random.Random(4)
    base = [f"i{k}" for k in range(60)]
    owners = {"empty": set()}
    for n in range(60):
        own = set(rng.sample(base, rng.randrange(1, 40)))
        owners[f"f{n}"] = own | {"hot"}
        if n % 3 == 0:
            owners[f"g{n}"] = {x for x in own if rng.random() > 0.08} | {"hot"}
            owners[f"h{n}"] = own | {"hot"}
    rows = [(f, i) for f, own in owners.items() for i in own] * 2 + [(None, "i1"), ("f1", None)]
    got = {tuple(r) for r in curate.near_duplicates(spark.createDataFrame(rows, "f string, i string"), "f", "i").collect()}
    want = set()
    for a, b in combinations(sorted(f for f, own in owners.items() if own), 2):
        both, na, nb = len(owners[a] & owners[b]), len(owners[a]), len(owners[b])
        if 100 * both >= 90 * min(na, nb):
            want.add((a, b, both, na, nb, "exact" if both == na == nb else "near"))
    assert got == want and any(r[5] == "near" for r in want)


def test_an_item_that_all_have_makes_no_candidates(spark):
    rows = spark.range(3_000).selectExpr("id as f", "explode(array('hot', concat('a', id), concat('b', id), concat('c', id % 1500))) as i")
    made = {}
    own = curate.materialize

    def kept(frame, name):
        made[name] = own(frame, name)
        return made[name]

    curate.materialize = kept
    try:
        assert curate.near_duplicates(rows, "f", "i", near=60).count() == 0
    finally:
        curate.materialize = own
    # Four items of which three are needed: the two rarest look for other sets, and nobody else has those.
    assert made["candidates"].count() == 0
