"""HTML extraction on unmarked pages of ordinary words, against a brute-force version, at every chunk size."""

import random

import pytest

from quillspark.llm import html_text

MENU, FOOT = "Home News Sport Contact Login", "All rights kept by the owner of this place since the year two thousand"


def site(seed, pages, vocabulary=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    advert = " ".join(rng.choice(words) for _ in range(15))
    out = []
    for i in range(pages):
        blocks = [MENU, " ".join(rng.choice(words) for _ in range(40)), FOOT]
        if i % 10 == 0:
            blocks.insert(2, " ".join(rng.choice(words) for _ in range(5)) + " " + advert)
        out.append(blocks)
    return out


def brute(pages, min_run=12):
    """What a page's blocks keep: no block that another page has, no run of min_run words that a block of another page has."""
    runs, whole = {}, {}
    for p, blocks in enumerate(pages):
        for b in blocks:
            words = b.split()
            whole.setdefault(b, set()).add(p)
            for i in range(len(words) - min_run + 1):
                runs.setdefault(tuple(words[i : i + min_run]), set()).add(p)
    out = []
    for blocks in pages:
        kept = []
        for b in blocks:
            words, gone = b.split(), set()
            for i in range(len(words) - min_run + 1):
                if len(runs[tuple(words[i : i + min_run])]) > 1:
                    gone.update(range(i, i + min_run))
            text = " ".join(w for j, w in enumerate(words) if j not in gone)
            if len(whole[b]) == 1 and text:
                kept.append(text)
        out.append("\n".join(kept))
    return out


@pytest.mark.parametrize("chunk, chars", [(2048, 4_000_000), (16, 4_000_000), (2048, 3_000)])
def test_paragraphs_of_shared_words_stay(spark, chunk, chars):
    pages = site(7, 200)
    rows = [(i, "http://h.com/x", "".join(f"<p>{b}</p>" for b in blocks)) for i, blocks in enumerate(pages)]
    rows += [(1000 + i, "http://m.com/", f"<article><p>article {i}</p></article><div>{MENU}</div>") for i in range(5)]
    rows += [(2000, "http://m.com/", "<script>x</script>"), (2001, "http://n.com/", "<p>alone</p>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), chunk=chunk, chunk_chars=chars).collect()}
    want = dict(enumerate(brute(pages))) | {1000 + i: f"article {i}" for i in range(5)} | {2000: "", 2001: "alone"}
    assert got == want
    assert all(pages[i][1] in got[i] and MENU not in got[i] and FOOT not in got[i] for i in range(200))


def test_marked_pages_are_not_shuffled(spark):
    rows = [(i, f"http://h{i % 3}.com/", f"<article><p>text {i}</p></article><p>{MENU}</p>") for i in range(30)]
    plan = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_very_long_page(spark):
    text = " ".join(f"x{i % 5000}" for i in range(300_000))
    rows = [(1, "http://h.com/", f"<p>{text}</p>"), (2, "http://h.com/", "<p>short one</p>" + "<div>" * 50_000)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: text, 2: "short one"}
