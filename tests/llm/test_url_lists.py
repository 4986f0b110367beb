"""URL lists as tables, dealt to several cascades, against brute force."""

import random

import pytest
from test_native import brute_url

from quillspark.llm import url_filter


def brute(url, rules, refused):
    host, path, _, _ = brute_url(url)
    best = max(((len(r), len(h), v == "block", r, v) for r, v in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)), default=None)
    bad = any(host == h or host.endswith("." + h) for h in refused)
    return (host, path, best[3] if best else None, best[4] if best else "block" if bad else "allow")


@pytest.mark.parametrize("most_bits, group", [(url_filter.MOST_BITS, 64), (2048, 64), (url_filter.MOST_BITS, 14)])
def test_tables_of_rules(spark, most_bits, group):
    rng = random.Random(5)
    name = lambda: ".".join(rng.choice("abcdef") * rng.randint(1, 2) for _ in range(rng.randint(1, 4)))
    rules = list({f"{name()}/{'/'.join(rng.choice(['en', 'de', 'x']) for _ in range(rng.randint(0, 2)))}": rng.choice(["allow", "block"]) for _ in range(200)}.items())
    refused = sorted({name() for _ in range(100)})
    urls = [None, "", "x://"] + [f"http://{name()}/{'/'.join(rng.choice(['en', 'de', 'x', 'y']) for _ in range(rng.randint(0, 3)))}{rng.choice(['', '?q', '#/en'])}" for _ in range(1500)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    tables = spark.createDataFrame([*rules, (None, "block")], "a string, b string"), spark.createDataFrame([(h,) for h in [*refused, None]], "c string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules=tables[0], refused=tables[1], most_bits=most_bits, group=group).collect()}
    assert got == {i: brute(u, rules, refused) for i, u in enumerate(urls)}
    assert url_filter.pieces_for(1000, 10**6, 2048) > 1


def test_a_level_stands_once_in_the_plan(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 50}.com/en/") for i in range(500)], "page_id long, url string")
    refused = spark.range(200_000).selectExpr("concat('h', id * 7, '.com') as host")
    judged = url_filter.judge(pages, rules=(), refused=refused)
    assert judged.where("verdict = 'block'").count() == 500 // 50 * len([i for i in range(50) if i % 7 == 0])
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 200_000 and "Join" not in plan


@pytest.mark.parametrize("few", [1024, 20, 0])
def test_short_lists_close_without_jobs(spark, few):
    """A list of few keys with few false ones behind it, one with too many false ones, and one built by jobs: all exact."""
    universe = spark.range(30_000).selectExpr("concat('k', id) as key")
    listed = spark.range(12).selectExpr("concat('k', id * 1000) as key")
    own = url_filter.bits_for
    try:
        url_filter.bits_for = lambda keys, error: max(64, own(keys, max(error, 0.001)))  # so that keys pass wrongly
        cascade = url_filter.Cascade(listed, universe, few=few)
    finally:
        url_filter.bits_for = own
    assert len(cascade.levels) > 1
    got = {r["key"] for r in universe.where(cascade.has(universe["key"])).collect()}
    assert got == {f"k{1000 * i}" for i in range(12)}
