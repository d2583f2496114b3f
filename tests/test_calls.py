import os
import time
import uuid

import pytest

from quillspark.plans import calls


def clerk(folder):
    """A client that notes each call in a folder, and what it has noted; ``moody`` prompts fail twice, ``broken`` ones always."""
    folder = str(folder)

    def client(prompts):  # made here, so that it travels to the tasks
        (prompt,) = prompts
        os.makedirs(f"{folder}/{prompt}", exist_ok=True)
        open(f"{folder}/{prompt}/{uuid.uuid4().hex}", "w").close()
        if prompt.startswith("broken") or (prompt.startswith("moody") and len(os.listdir(f"{folder}/{prompt}")) < 3):
            raise RuntimeError(f"no answer to {prompt}")
        return [prompt.upper()]

    return client, lambda: {p: len(os.listdir(f"{folder}/{p}")) for p in os.listdir(folder)}


def answers(df):
    return sorted(((r["id"], r["reply"], r["error"], r["attempts"]) for r in df.select("id", "reply", "error", "attempts").collect()), key=repr)


def test_calls_are_retried_and_made_once(spark, tmp_path):
    client, made = clerk(tmp_path)
    prompts = ["same"] * 40 + ["moody", "moody", "broken", None, "other"]
    rows = spark.createDataFrame(list(enumerate(prompts)), "id long, prompt string")
    got = answers(calls.called(rows, "prompt", client, wait=0.01))
    error = "RuntimeError: no answer to broken"
    expected = {"same": ("SAME", None, 1), "moody": ("MOODY", None, 3), "broken": (None, error, 3), "other": ("OTHER", None, 1), None: (None, None, 0)}
    assert got == sorted(((i, *expected[p]) for i, p in enumerate(prompts)), key=repr)
    assert made() == {"same": 1, "moody": 3, "broken": 3, "other": 1}


def test_replies_are_kept(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    (client, made), cache = clerk(tmp_path / "calls"), calls.reply_cache(spark, f"file://{tmp_path}/replies")
    rows = spark.createDataFrame([(1, "a"), (2, "broken"), (3, "a")], "id long, prompt string")
    calls.called(rows, "prompt", client, cache, wait=0.01)
    assert made() == {"a": 1, "broken": 3}
    more = spark.createDataFrame([(1, "a"), (2, "broken"), (3, "new"), (4, None)], "id long, prompt string")
    got = answers(calls.called(more, "prompt", client, cache, wait=0.01))
    assert got == sorted([(1, "A", None, 0), (2, None, "RuntimeError: no answer to broken", 3), (3, "NEW", None, 1), (4, None, None, 0)], key=repr)
    assert made() == {"a": 1, "broken": 6, "new": 1}
    assert sorted(r["reply"] for r in cache.read().collect()) == ["A", "NEW"]


def test_named_tasks_and_waits(spark):
    rows = spark.createDataFrame([(1, "One. Two. Three. Four.")], "id long, prompt string")
    assert answers(calls.called(rows, "prompt", "summary")) == [(1, "One. Two. Three.", None, 1)]
    waits = []

    def never(prompts):
        raise ValueError("x")

    assert calls.attempted(never, "p", 4, 1.0, waits.append) == (None, "ValueError: x", 4) and waits == [1.0, 2.0, 4.0]
    with pytest.raises(ValueError, match="attempts"):
        calls.attempted(never, "p", 0)


def test_calls_run_side_by_side():
    import pandas as pd

    def slow(prompts):
        time.sleep(0.2)
        return prompts

    frame = pd.DataFrame({"prompt_key": [str(i) for i in range(8)], "prompt": [f"p{i}" for i in range(8)]})
    began = time.time()
    (out,) = calls._asked(slow, 8, 1, 0.0)([frame])
    assert time.time() - began < 1.2 and out["reply"].tolist() == frame["prompt"].tolist()
