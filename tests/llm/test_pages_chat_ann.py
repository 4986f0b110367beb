import json
import math
import random

import numpy as np
import pytest

from quillspark.llm import ann_forest, chat, html_text, repetition
from quillspark.llm.suffixes import longest_repeats, suffix_array

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
<article><header><h1>Head &amp; line</h1><p>By me</p></header><p><b>First &lt;b&gt;.<br>second   part<p>Third&nbsp;one<ul><li>x<li>y</ul>
<div id="cookie-notice">We use</div><form>Name <input></form><p class=advert>Offer<p>Last</article>
<section class="comments"><p>I agree</p></section><aside>Side</aside><footer>&copy; x</footer></body></html>"""


def test_blocks_of_a_marked_article():
    assert [t for t, inside in html_text.blocks_of(PAGE) if inside] == ["Head & line", "First <b>. second part", "Third one", "x", "y", "Last"]
    assert html_text.blocks_of(None) == html_text.blocks_of("") == []
    assert html_text.blocks_of("<p>a < b</p>c") == [("a < b", False), ("c", False)]
    assert html_text.blocks_of("<!-- open") == [] and html_text.blocks_of("bare") == [("bare", False)]


def test_extract(spark):
    bare = "<body><div>Home News Contact</div><p>{0} own words of page {0}</p><div>All rights kept here</div></body>"
    rows = [(1, "http://h.com/1", PAGE), (2, None, None), (None, "http://h.com/2", ""), (3, "http://s.com/", "<p>alone</p>")]
    rows += [(10 + i, f"http://B.com/{i}", bare.format(f"n{i}")) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as host")
    got = {r.page_id: r.text for r in html_text.extract(pages, chunk=8).collect()}
    assert got[1] == "Head & line\nFirst <b>. second part\nThird one\nx\ny\nLast" and got[2] == got[None] == "" and got[3] == "alone"
    assert all(got[10 + i] == f"n{i} own words of page n{i}" for i in range(40))
    assert html_text.extract(pages.limit(0)).count() == 0


def test_blocks_of_shared_words_stay():
    """Every word stands on other pages of the host; only whole blocks and runs of 12 words that do are boilerplate."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    own = [[" ".join(rng.choices(words, k=n)) for n in (9, 15, 40)] + [f"w{i}"] for i in range(25)]
    notice = " ".join(f"v{i}" for i in range(14))
    pages = [["Home News", *blocks, f"e{i} {notice}", "w1 w2 again"] for i, blocks in enumerate(own)]
    got = html_text.unique_text(pages, [0] * 25, [True] * 25, 12)
    assert got == ["\n".join([*blocks, f"e{i}"]) for i, blocks in enumerate(own)]
    alone = html_text.unique_text([["a b"], ["a b"], ["c a b"]], [0, 1, 0], [True] * 3, 12)
    assert alone == ["a b", "a b", "c a b"]


def test_repeats_between_chunks(spark):
    """What stands on two pages of a host goes, in whatever chunks they are: the result doesn't depend on the chunk."""
    rng = random.Random(9)
    notes = [" ".join(f"{k}x{rng.randrange(10**6)}" for _ in range(n)) for k in range(20) for n in (14, 5)]
    pages = [[f"own{i} words", f"e{i} {notes[i % 20 * 2]}", notes[i % 20 * 2 + 1]] for i in range(40)]
    rows = [(i, "http://h.com/", "".join(f"<p>{b}</p>" for b in blocks)) for i, blocks in enumerate(pages)]
    rows.append((40, "http://h.com/", "<article><p>mine</p></article><p>own3 words</p>"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    small, large = ({r.page_id: r.text for r in html_text.extract(frame, chunk=n).collect()} for n in (100, 4))
    want = {i: f"own{i} words\ne{i}" for i in range(40)} | {3: "e3", 40: "mine"}
    assert small == want and large == want


def test_suffix_array_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        streams = [[rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randrange(40))] for _ in range(rng.randrange(1, 6))]
        tokens = np.array([t for s in streams for t in s], np.int64)
        sizes = np.array([len(s) for s in streams])
        stop = np.cumsum(sizes)
        sa, lcp = suffix_array(tokens, np.repeat(np.arange(len(streams)), sizes), np.repeat(stop, sizes))
        length = longest_repeats(sa, lcp)
        at = 0
        for s in streams:
            for i in range(len(s)):
                best = 0
                for j in range(len(s)):
                    m = 0
                    while i != j and max(i, j) + m < len(s) and s[i + m] == s[j + m]:
                        m += 1
                    best = max(best, m)
                assert length[at + i] == best
            at += len(s)


def brute_rules(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    length = [0] * n
    for i in range(n):
        for j in range(n):
            m = 0
            while i != j and max(i, j) + m < n and words[i + m] == words[j + m]:
                m += 1
            length[i] = max(length[i], m)
    cover = lambda least: len({p for i in range(n) if length[i] >= least for p in range(i, i + length[i])})
    failed = n < 10 or 100 * cover(5) > 20 * n
    kept = not failed and cover(10) <= 0.2 * n and max(length, default=0) <= 100
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, cover(5), failed, kept, cover(10), max(length, default=0))


def test_quality_rules(spark):
    rng = random.Random(8)
    texts = [None, "", " \n\x1c\x85\n", "a " * 120, "é#*$ %&|<> x"]
    for _ in range(60):
        words = [rng.choice("ab cd ef gh ij é".split()) if rng.random() < 0.3 else f"w{rng.randrange(5000)}" for _ in range(rng.randrange(5, 120))]
        if rng.random() < 0.5:
            words += words[: rng.randrange(1, 40)]
        texts.append("".join(w + rng.choice([" ", " ", "\n", "\t ", "\n\n"]) for w in words))
    texts += ["\n".join(["one line of words here"] * 3)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 as kept", "2 as spans")
    rows = {r.doc_id: r for r in repetition.quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.covered_words, r.longest_repeat) == brute_rules(t), repr(t)
        assert sum(s["last"] - s["first"] + 1 for s in r.spans) == r.covered_words
    assert {r.doc_id for r in repetition.keep_good(docs).collect()} == {i for i, r in rows.items() if r.kept}
    assert repetition.quality_rules(docs.limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(3000, 16))
    vectors[5::7] *= 3
    vectors[100:160] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(5000, None), (5020, []), (5040, [0.0] * 16), (5060, [math.nan] * 16), (5080, [None] * 16), (5100, [math.inf] * 16), (5120, [1.0, 2.0]), (None, [1.0] * 16)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 as shard", "2 as vector")
    got = ann_forest.nearest(frame, lambda c: c % 20 == 0, shard_rows=700, block=60).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(range(0, 3000, 20))
    hits = 0
    for q, found in by.items():
        scores = (vectors * vectors[q]).sum(axis=1)
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(s == scores[v] for _, v, s in found) and q not in [v for _, v, _ in found]
        assert [(v, s) for _, v, s in found] == sorted(((v, s) for _, v, s in found), key=lambda x: (-x[1], x[0]))
        best = np.lexsort((np.arange(3000), -scores))
        hits += len({v for _, v, _ in found} & set(best[best != q][:20].tolist()))
    assert hits / (20 * len(by)) >= 0.9
    assert ann_forest.nearest(frame.limit(0), lambda c: c % 20 == 0).count() == 0


def call(i, name, **arguments):
    return f"<tool_call>{json.dumps({'name': name, 'id': i, 'arguments': arguments})}</tool_call>"


def test_tool_calls(spark):
    told = lambda i, content: f"<tool_result>{json.dumps({'id': i, 'content': content})}</tool_result>"
    rows = [
        (1, 0, "user", 'say "é"\n'),
        (1, 1, "assistant", "ok " + call("b", "search", query="$a", limit=2) + call("a", "calculate", expression="1")),
        (1, 2, "tool", told("a", {"z": 1, "a": [True]}) + told("b", "x")),
        (2, 0, "assistant", call("a", "search", limit="x", more=1) + call("a", "none") + "<tool_call>{bad</tool_call>"),
        (3, 0, "assistant", call("p", "calculate", expression="$q") + call("q", "calculate", expression="$p")),
        (4, 0, None, None),
        (None, 0, "system", "s"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth", "2 as calls")
    got = {(r.conv_id, r.turn): r for r in chat.format_messages(frame).collect()}
    assert len(got) == len(rows)
    assert json.loads(got[1, 0].message_json) == {"content": 'say "é"\n', "role": "user"}
    assert got[1, 1].message_json == '{"content":"ok","role":"assistant","tool_calls":[{"arguments":{"expression":"1"},"id":"a","name":"calculate","result":{"a":[true],"z":1}},{"arguments":{"limit":2,"query":"$a"},"id":"b","name":"search","result":"x"}]}'
    assert got[1, 1].n_faults == 0 and got[4, 0].message_json == '{"content":null,"role":null}'
    links = {(r.conv_id, r.turn, r.place): r for r in chat.link_calls(frame).collect()}
    assert links[1, 1, 0].depth == 1 and links[1, 1, 1].depth == 0 and links[3, 0, 0].depth == -1
    assert links[2, 0, 0].faults == ["repeated identifier", "no result", "limit: not integer", "query: missing", "more: unknown"]
    assert links[2, 0, 1].faults == ["repeated identifier", "no result", "unknown tool"]
    assert links[2, 0, 2].faults == ["no identifier", "no result", "no name"]
    assert "cycle" in links[3, 0, 1].faults
    assert chat.format_messages(frame.limit(0)).count() == 0


def test_calls_with_null_keys(spark):
    rows = [
        (None, 1, "assistant", call("b", "search", query="$a") + call("a", "calculate", expression="1")),
        (None, 2, "tool", '<tool_result>{"id":"a","content":7}</tool_result><tool_result>{"id":"b","content":8}</tool_result>'),
        (5, None, "assistant", call("c", "calculate", expression="2")),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in chat.format_messages(frame).collect()}
    assert (got[None, 1].n_calls, got[None, 1].n_faults, got[5, None].n_calls, got[5, None].n_faults) == (2, 0, 1, 1)
    assert [(c["id"], c["result"]) for c in json.loads(got[None, 1].message_json)["tool_calls"]] == [("a", 7), ("b", 8)]


@pytest.mark.parametrize("size", [0, 1])
def test_runs(size):
    assert repetition.runs(np.ones(size, bool)) == [{"first": 0, "last": 0}] * size
