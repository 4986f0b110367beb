import json
import os
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.streaming import model_runs
from quillspark.streaming.model_runs import Model, answers


def test_retry_then_next_model():
    waits, seen = [], []

    def first(prompts):
        seen.append(list(prompts))
        return [None if p == "b" or (p == "c" and len(seen) < 3) else f"1{p}" for p in prompts]

    found = answers(["a", "b", None, "c"], [Model("one", first), Model("two", lambda ps: [f"2{p}" for p in ps])], tries=3, wait=2, longest=3, sleep=waits.append)
    assert seen == [["a", "b", "c"], ["b", "c"], ["b", "c"]] and waits == [2, 3]
    assert [tuple(x) for x in found] == [("1a", "one", 1, None), ("2b", "two", 4, None), (None, None, 0, "no prompt"), ("1c", "one", 3, None)]


def test_a_prompt_that_raises_spoils_no_other():
    def client(prompts):
        if "bad" in prompts:
            raise OSError("down")
        return [p.upper() for p in prompts]

    found = answers(["a", "bad", "b"], [Model("m", client)], tries=2, sleep=lambda _: None)
    assert [(x.reply, x.tries, x.error) for x in found] == [("A", 2, None), (None, 2, "m: OSError: down"), ("B", 2, None)]
    short = answers(["a"], [Model("m", lambda ps: [])], tries=1)
    assert short[0].reply is None and "0 replies to 1 prompts" in short[0].error
    assert answers([], [Model("m", client)]) == []


@pytest.mark.parametrize("seed", range(20))
def test_answers_against_one_at_a_time(seed):
    """With clients that answer or not by prompt and call number, lists and single prompts give the same."""
    draw = random.Random(seed)
    needs = {(m, p): draw.randint(1, 5) for m in "xy" for p in range(12)}

    def client(name):
        asked = {}

        def ask(prompts):
            out = []
            for p in prompts:
                asked[p] = asked.get(p, 0) + 1
                out.append(f"{name}{p}" if asked[p] >= needs[name, int(p)] else None)
            return out

        return Model(name, ask)

    whole = answers([str(p) for p in range(12)], [client("x"), client("y")], tries=3, sleep=lambda _: None)
    for p, got in enumerate(whole):
        x, y = needs["x", p], needs["y", p]
        want = (f"x{p}", "x", x) if x <= 3 else (f"y{p}", "y", 3 + y) if y <= 3 else (None, None, 6)
        assert (got.reply, got.model, got.tries) == want


def client_of(log, broken=None):
    """A client that writes down what it is asked, a file a call; where a file `broken` is there, prompt p7 kills its task after a while."""

    def ask(prompts):
        import uuid

        if broken and os.path.exists(broken) and "p7" in prompts:
            time.sleep(4)
            raise SystemExit("killed")
        with open(f"{log}/{uuid.uuid4().hex}", "w") as out:
            json.dump(prompts, out)
        return [f"seen {p}" for p in prompts]

    return Model("stub", ask)


def asked(log):
    return sorted(p for name in os.listdir(log) for p in json.load(open(f"{log}/{name}")))


def test_a_run_in_two_calls_asks_nothing_twice(spark, tmp_path):
    log, folder = tmp_path / "log", f"file://{tmp_path}/run"
    log.mkdir()
    prompts = spark.range(500).select(F.col("id").alias("k"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    models = [client_of(str(log))]
    assert model_runs.enqueue(prompts, "k", folder, rows=50) == 500
    assert model_runs.enqueue(prompts, "k", folder, rows=50) == 0
    assert model_runs.resume(spark, "k", "long", folder, models, files=3, most=1) == 1
    part = asked(log)
    assert 0 < len(part) < 500 and model_runs.replies(spark, "k", "long", folder).count() == len(part)
    assert model_runs.resume(spark, "k", "long", folder, models, files=3) > 0
    assert model_runs.enqueue(prompts.unionByName(prompts.withColumn("k", F.col("k") + 400)), "k", folder) == 400
    assert model_runs.resume(spark, "k", "long", folder, models) == 1
    assert model_runs.resume(spark, "k", "long", folder, models) == 0
    assert len(asked(log)) == 900
    rows = model_runs.replies(spark, "k", "long", folder).collect()
    assert sorted(r.k for r in rows) == list(range(900)) and all(r.reply == f"seen {r.prompt}" and r.tries == 1 for r in rows)


def test_a_killed_run_goes_on(spark, tmp_path):
    """The run dies inside a batch; what its ended tasks wrote isn't asked again, and the end is that of an unbroken run."""
    log, folder, broken = tmp_path / "log", f"file://{tmp_path}/run", tmp_path / "broken"
    log.mkdir()
    broken.touch()
    prompts = spark.range(300).select(F.col("id").alias("k"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    model_runs.enqueue(prompts, "k", folder, rows=5)
    with pytest.raises(Exception):  # noqa: B017  (the stream's own)
        model_runs.resume(spark, "k", "long", folder, [client_of(str(log), str(broken))], files=60, size=5)
    time.sleep(2)  # for tasks that were running
    before = asked(log)
    kept = {r.prompt for r in model_runs.replies(spark, "k", "long", folder).collect()}
    assert kept and "p7" not in kept
    broken.unlink()
    model_runs.resume(spark, "k", "long", folder, [client_of(str(log))], files=60, size=5)
    rows = model_runs.replies(spark, "k", "long", folder).collect()
    assert sorted((r.k, r.reply) for r in rows) == sorted((k, f"seen p{k}") for k in range(300))
    twice = {p for p, n in Counter(asked(log)).items() if n > 1}
    assert twice <= set(before) - kept, "a written reply was asked for again"


def test_odd_prompts(spark, tmp_path):
    folder = f"file://{tmp_path}/run"
    rows = spark.createDataFrame([(None, "x", 1), (1, None, 1), (2, "b", 1), (2, "a", 1), (3, "", 1)], "k long, prompt string, reply int")
    assert model_runs.replies(spark, "k", "long", folder).count() == 0
    assert model_runs.enqueue(rows, "k", folder) == 4
    model_runs.resume(spark, "k", "long", folder, [Model("stub", lambda ps: [f"<{p}>" for p in ps])])
    found = {r.k: (r.reply, r.model, r.tries, r.error) for r in model_runs.replies(spark, "k", "long", folder).collect()}
    assert found == {None: ("<x>", "stub", 1, None), 1: (None, None, 0, "no prompt"), 2: ("<a>", "stub", 1, None), 3: ("<>", "stub", 1, None)}
    assert model_runs.enqueue(rows, "k", folder) == 0
    empty = f"file://{tmp_path}/empty"
    assert model_runs.enqueue(rows.where("false"), "k", empty) == 0 and model_runs.resume(spark, "k", "long", empty, []) == 0
