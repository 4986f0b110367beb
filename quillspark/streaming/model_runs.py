"""A model run that resumes: prompts in a written table, replies by micro-batches, repeated tries, further models."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources import readers


class Model(NamedTuple):
    """A name, and a client: a list of prompts to as many replies. A null reply and an exception are failures."""

    name: str
    ask: Callable[[list[str]], list[str | None]]


class Answer(NamedTuple):
    reply: str | None
    model: str | None
    tries: int
    error: str | None


def answers(prompts: list[str | None], models: list[Model], tries: int = 3, wait: float = 1.0, longest: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> list[Answer]:
    """Each prompt's reply by the first model that answers it, asked up to `tries` times before the next one is.

    Only prompts without a reply are asked again, after a wait that doubles up to `longest`. Prompts whose list raised are
    asked one by one from then on, so one of them can't spoil the others. `tries` counts all calls that held the prompt.
    A null prompt isn't asked.
    """
    said: list[str | None] = [None] * len(prompts)
    by, calls, error = [None] * len(prompts), [0] * len(prompts), [None if p is not None else "no prompt" for p in prompts]
    for name, ask in models:
        open_ = [i for i, p in enumerate(prompts) if p is not None and said[i] is None]
        together, pause = True, wait
        for attempt in range(tries):
            if not open_:
                break
            if attempt:
                sleep(pause)
                pause = min(2 * pause, longest)
            raised = False
            for asked in [open_] if together else [[i] for i in open_]:
                for i in asked:
                    calls[i] += 1
                try:
                    replies = ask([prompts[i] for i in asked])
                    if len(replies) != len(asked):
                        raise ValueError(f"{len(replies)} replies to {len(asked)} prompts")
                except Exception as fault:  # noqa: BLE001  (whatever a client raises is a failed try; the last one is written down)
                    raised = True
                    for i in asked:
                        error[i] = f"{name}: {type(fault).__name__}: {fault}"
                    continue
                for i, reply in zip(asked, replies, strict=True):
                    said[i], by[i], error[i] = (reply, name, None) if reply is not None else (None, None, f"{name}: no reply")
            together = together and not raised
            open_ = [i for i in open_ if said[i] is None]
    return [Answer(*each) for each in zip(said, by, calls, error, strict=True)]


def ask(prompts: DataFrame, models: list[Model], prompt: str = "prompt", size: int = 64, **how) -> DataFrame:
    """Prompts with (reply, model, tries, error), asked in lists of `size` on the workers. A prompt that no model answers stays, with its error."""

    def run(frames: Iterable[pd.DataFrame]):
        for frame in frames:
            found = [x for first in range(0, len(frame), size) for x in answers([p if isinstance(p, str) else None for p in frame[prompt][first : first + size]], models, **how)]
            columns = zip(*found, strict=True) if found else [[]] * 4
            yield frame.assign(**{c: pd.Series(list(v), index=frame.index, dtype="int64" if c == "tries" else object) for c, v in zip(Answer._fields, columns, strict=True)})

    empty = prompts.select(*prompts.columns, *(F.lit(None).cast("long" if c == "tries" else "string").alias(c) for c in Answer._fields))
    return prompts.mapInPandas(run, empty.schema)


def enqueue(prompts: DataFrame, key: str, folder: str, prompt: str = "prompt", rows: int = 1_000) -> int:
    """Adds prompts whose key the run's table doesn't have yet, in files of about `rows`; returns how many it added.

    Of several prompts of a key the smallest is taken. A null key is a key. A call that was broken off can be repeated.
    """
    spark, at = prompts.sparkSession, f"{folder}/prompts"
    new = prompts.select(key, prompt).groupBy(key).agg(F.min(prompt).alias(prompt))
    schema = new.schema
    if readers.first_existing(spark, [at]):
        old = spark.read.schema(schema).parquet(at).select(F.col(key).alias("_known"))
        new = new.join(old, F.col(key).eqNullSafe(F.col("_known")), "left_anti")
    n = new.count()
    if n:
        new.repartition(max(1, -(-n // rows)), key).write.mode("append").parquet(at)
    return n


def resume(spark: SparkSession, key: str, kind: str, folder: str, models: list[Model], prompt: str = "prompt", files: int = 64, most: int | None = None, **how) -> int:
    """K7: asks what a run's table holds and hasn't been asked, a micro-batch of `files` files at a time; returns the number of batches.

    kind: the key's type. Structured Streaming's checkpoint in the folder says which files are done. A task's replies are
    visible when it ends, and a batch that was broken off asks only the rest, so at most the prompts of tasks that were running are
    asked again. `most` ends the call after so many batches; the next call goes on.
    """
    at, left = f"{folder}/replies", [0]
    if not readers.first_existing(spark, [f"{folder}/prompts"]):
        return 0
    schema = f"`{key}` {kind}, `{prompt}` string"

    class Enough(Exception):
        pass

    def write(batch: DataFrame, number: int) -> None:
        if most is not None and left[0] >= most:
            raise Enough
        there = f"{at}/batch={number}"
        if readers.first_existing(batch.sparkSession, [there]):
            done = batch.sparkSession.read.schema(f"`{key}` {kind}").parquet(there).select(F.col(key).alias("_known"))
            batch = batch.join(done, F.col(key).eqNullSafe(F.col("_known")), "left_anti")
        # Version 2 of the committer moves each task's file into place when the task ends, not when the job does.
        ask(batch, models, prompt, **how).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(there)
        left[0] += 1

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/prompts")
    stream = source.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        stream.awaitTermination()
    except StreamingQueryException as ended:
        if "Enough" not in str(ended) or most is None or left[0] < most:
            raise
    return left[0]


def replies(spark: SparkSession, key: str, kind: str, folder: str, prompt: str = "prompt") -> DataFrame:
    """The replies so far, one a key: (key, prompt, reply, model, tries, error). Of two of a key (a task that was repeated) the smaller one."""
    schema = f"`{key}` {kind}, `{prompt}` string, reply string, model string, tries long, error string"
    if not readers.first_existing(spark, [f"{folder}/replies"]):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", f"{folder}/replies").parquet(f"{folder}/replies/batch=*")
    rest = [prompt, *Answer._fields]
    return rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))
