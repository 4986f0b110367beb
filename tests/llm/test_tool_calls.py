"""Tool-call linking against brute force: depths of random reference graphs, repeated rows, malformed bodies, null keys."""

import json
import random

import pytest

from quillspark.llm import chat


def call(i, refers):
    return f"<tool_call>{json.dumps({'id': i, 'name': 'calculate', 'arguments': {'expression': [f'${r}' for r in refers]}})}</tool_call>"


def brute_depths(graph):
    """Longest way down by repeated relaxation; -1 for what reaches a cycle."""
    out = {}
    graph = {i: [r for r in refers if r in graph] for i, refers in graph.items()}
    while True:
        ready = [i for i in graph if i not in out and all(r in out for r in graph[i])]
        if not ready:
            return {i: out.get(i, -1) for i in graph}
        out |= {i: max((out[r] + 1 for r in graph[i]), default=0) for i in ready}


def test_depths_against_brute_force(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for conv in [None, *range(30)]:
        n = rng.randrange(1, 14)
        graph = {f"c{i}": sorted({f"c{rng.randrange(-1, n)}" if rng.random() < 0.15 else f"c{rng.randrange(i - 3, i)}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))}) for i in range(n)}
        rows += [(conv, rng.randrange(5), "assistant", call(i, refers)) for i, refers in graph.items()]
        want |= {(conv, i): d for i, d in brute_depths(graph).items()}
    chain = {f"c{i}": [f"c{i - 1}"] for i in range(1, 60)} | {"c0": []}
    rows += [(99, 0, "assistant", "".join(call(i, refers) for i, refers in chain.items()))]
    want |= {(99, i): d for i, d in brute_depths(chain).items()}
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.call_id): r.depth for r in chat.link_calls(frame).collect()}
    assert got == want and min(want.values()) == -1 and max(want.values()) == 59


def test_repeated_rows_count_once(spark):
    text = '<tool_call>{"id":"a","name":"calculate","arguments":{"expression":"1"}}</tool_call>'
    rows = [(1, 0, "assistant", text)] * 3 + [(1, 1, "tool", '<tool_result>{"id":"a","content":5}</tool_result>')] * 2 + [(1, 0, "assistant", text.replace('"a"', '"b"'))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [(r.n_calls, r.n_faults, r.message_json) for r in chat.format_messages(frame).collect() if r.role == "assistant"]
    one = '{"content":"","role":"assistant","tool_calls":[{"arguments":{"expression":"1"},"id":"a","name":"calculate","result":5}]}'
    assert sorted(got)[:3] == [(1, 0, one)] * 3
    assert len(got) == 4 and sorted(got)[3][:2] == (1, 1) and '"id":"b"' in sorted(got)[3][2]


@pytest.mark.parametrize("body", ["{bad", "", "[1]", '{"id":"a","name":"calculate","arguments":{"expression":"1"},"extra":1}', "x" * 200_000])
def test_a_malformed_body_is_kept(spark, body):
    frame = spark.createDataFrame([(1, 0, "assistant", f"so <tool_call>{body}</tool_call>")], "conv_id long, turn long, role string, text string")
    row = chat.format_messages(frame).first()
    assert row.n_calls == 1 and row.n_faults > 0
    assert json.loads(row.message_json)["tool_calls"][0]["raw"] == body
