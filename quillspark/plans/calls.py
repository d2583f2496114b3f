"""Calls of a model that may fail: each distinct prompt once, a few at a time, with retries, and replies kept by prompt."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans.models import TASKS, Task
from quillspark.sources.keyed import KeyedTable
from quillspark.tables import staged

#: Calls at once in a task, attempts for a prompt, and seconds before the second; each later wait is twice as long.
AT_ONCE, ATTEMPTS, WAIT = 4, 3, 0.5
_REPLY = "prompt_key string, reply string, error string, attempts int"


def attempted(client: Task, prompt: str, attempts: int = ATTEMPTS, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int]:
    """(reply, error, attempts) of one prompt: an exception is tried again, and the last one is the error."""
    for n in range(1, attempts + 1):
        try:
            return client([prompt])[0], None, n
        except Exception as e:  # whatever a client raises is its answer's error, not the job's
            if n == attempts:
                return None, f"{type(e).__name__}: {e}", n
            sleep(wait * 2 ** (n - 1))
    raise ValueError("attempts must be 1 or more")


def _asked(client: Task, at_once: int, attempts: int, wait: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for pdf in batches:
                found = list(pool.map(lambda p: attempted(client, p, attempts, wait), pdf["prompt"]))
                out = pd.DataFrame(found, columns=["reply", "error", "attempts"])
                yield pd.DataFrame({"prompt_key": pdf["prompt_key"].to_numpy(), **out})

    return run


def reply_cache(spark: SparkSession, path: str) -> KeyedTable:
    """A stored table of replies by prompt, for ``called``."""
    return KeyedTable(spark, path, "prompt_key string, reply string, called_at timestamp", ("prompt_key",))


def called(
    rows: DataFrame, prompt: str, task: str | Task, cache: KeyedTable | None = None, *, tasks: int = 8, at_once: int = AT_ONCE, attempts: int = ATTEMPTS, wait: float = WAIT
) -> DataFrame:
    """``rows`` with ``reply``, ``error`` and ``attempts`` of a task (a name or a client) for the ``prompt`` column.

    A prompt that many rows have is asked once, and not at all if the cache knows its reply; then ``attempts`` is 0. At
    most ``tasks`` times ``at_once`` calls run at once over the cluster. A prompt whose last attempt fails has a null
    reply and its error; its rows stay, the others are not affected, and it is asked again next time. Null prompts have
    null replies and no attempts. A task that is run again on another executor asks its prompts again.
    """
    client = TASKS[task] if isinstance(task, str) else task
    keyed = rows.withColumn("prompt_key", F.sha2(F.col(prompt), 256))
    # one row of each prompt, which a task needs no other of
    asked = keyed.where("prompt_key is not null").groupBy("prompt_key").agg(F.first(prompt).alias("prompt"))
    known = None
    if cache is not None:
        known = cache.read().select("prompt_key", "reply", F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"))
        asked = asked.join(known.select("prompt_key"), "prompt_key", "left_anti")
    found = staged(asked.repartition(tasks).mapInPandas(_asked(client, at_once, attempts, wait), _REPLY), "replies")
    replies = found
    if cache is not None:
        # the rows as they were before this call's own replies join them
        replies = found.unionByName(staged(known.join(keyed.select("prompt_key").distinct(), "prompt_key", "left_semi"), "known"))
        cache.merge(found.where("error is null").select("prompt_key", "reply", F.current_timestamp().alias("called_at")), F.col("called_at"))
    return keyed.join(replies, "prompt_key", "left").drop("prompt_key").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
