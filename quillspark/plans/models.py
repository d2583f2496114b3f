"""Model calls behind one interface; the defaults are deterministic stand-ins that need no model and equal none."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: A task takes prompts (a list of strings) and returns as many replies.
Task = Callable[[list[str]], list[str]]
TASKS: dict[str, Task] = {}


def task(f: Task) -> Task:
    TASKS[f.__name__] = f
    return f


@task
def summary(prompts: list[str]) -> list[str]:
    """The first three sentences."""
    return [" ".join(re.split(r"(?<=[.!?])\s+", p)[:3]) for p in prompts]


@task
def hypothesis(prompts: list[str]) -> list[str]:
    """The query itself, as the fallback of a hypothetical document."""
    return prompts


@task
def decomposition(prompts: list[str]) -> list[str]:
    """One numbered line per clause."""
    return ["\n".join(f"{i}. {c.strip()}" for i, c in enumerate(re.split(r"\band\b|[;?]", p), 1) if c.strip()) for p in prompts]


@task
def intent(prompts: list[str]) -> list[str]:
    """``followup`` for short referring messages, ``conversational`` for greetings, else ``retrieval``."""
    out = []
    for p in prompts:
        t = p.strip().lower()
        short = len(t.split()) < 6
        out.append("conversational" if re.match(r"(hi|hello|thanks|thank you)\b", t) else "followup" if short and re.search(r"\b(it|that|they|this)\b", t) else "retrieval")
    return out


@task
def grounded(prompts: list[str]) -> list[str]:
    """An extractive answer: the opening of the context, with its first chunk cited."""
    out = []
    for p in prompts:
        found = re.search(r"\[chunk_id: ([^\]]+)\]", p)
        body = re.sub(r"\[[^\]]*\]", "", p).strip()
        out.append(body.split(".")[0][:200] + (f". [CITE:{found[1]}]" if found else "."))
    return out


@task
def expansion(prompts: list[str]) -> list[str]:
    """The query and its distinct longer words, as a passage that a query is widened by."""
    return [" ".join([p, *dict.fromkeys(w for w in re.findall(r"\w+", p.lower()) if len(w) > 3)]) for p in prompts]


@task
def condensation(prompts: list[str]) -> list[str]:
    """The last line of the history and question, without the speaker's name."""
    return [re.sub(r"^\w+:\s*", "", p.strip().split("\n")[-1]) for p in prompts]


@task
def entities(prompts: list[str]) -> list[str]:
    """Lines ``LABEL: text`` of years, numbers and capitalised words."""
    out = []
    for p in prompts:
        rows = [("DATE", m) for m in re.findall(r"\b(?:19|20)\d\d\b", p)] + [("NAME", m) for m in re.findall(r"\b[A-Z][a-z]{2,}\b", p)]
        out.append("\n".join(f"{a}: {b}" for a, b in dict.fromkeys(rows)))
    return out


@task
def extraction(prompts: list[str]) -> list[str]:
    """A JSON graph: the capitalised words, each linked to the next."""
    out = []
    for p in prompts:
        names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-zA-Z]{2,}\b", p)))
        links = [{"source": a, "target": b, "relation": "NEXT", "weight": 1.0} for a, b in zip(names, names[1:], strict=False)]
        out.append(json.dumps({"entities": [{"name": n, "entity_type": "TERM"} for n in names], "relationships": links}))
    return out


@task
def conflict(prompts: list[str]) -> list[str]:
    """``YES`` where passages parted by rules hold different numbers and nothing in common."""
    out = []
    for p in prompts:
        found = [set(re.findall(r"\d+", part)) for part in p.split("---")]
        found = [f for f in found if f]
        out.append("YES" if len(found) > 1 and not set.intersection(*found) else "NO")
    return out


@task
def claims(prompts: list[str]) -> list[str]:
    """JSON of the answer's sentences with whether half of their longer words are in the context (answer first, then ``CONTEXT:``)."""
    out = []
    for p in prompts:
        answer, _, context = p.partition("CONTEXT:")
        known = set(re.findall(r"\w+", context.lower()))
        rows = []
        for c in filter(None, re.split(r"(?<=[.!?])\s+", answer.strip())):
            words = [w for w in re.findall(r"\w+", c.lower()) if len(w) > 3]
            rows.append({"claim": c, "grounded": sum(w in known for w in words) * 2 >= len(words)})
        out.append(json.dumps({"claims": rows}))
    return out


@task
def judgement(prompts: list[str]) -> list[str]:
    """A score between 0 and 1: the share of distinct words, as a measure that needs no model."""
    return [f"score: {len(set(w)) / len(w):.3f}" if (w := p.lower().split()) else "no score" for p in prompts]


@task
def questions(prompts: list[str]) -> list[str]:
    """JSON pairs of a question and an answer, one for each of the first two sentences."""
    rows = [[{"question": f"What is said about {' '.join(s.split()[:3])}?", "answer": s} for s in re.split(r"(?<=[.!?])\s+", p)[:2] if s] for p in prompts]
    return [json.dumps({"pairs": r}) for r in rows]


@task
def variants(prompts: list[str]) -> list[str]:
    """The query asked in two other ways."""
    return [f"1. Please tell me: {p}\n2. {p} Answer briefly." for p in prompts]


@task
def history_answer(prompts: list[str]) -> list[str]:
    """The line after the last earlier asking of the same question (last line), else ``NEEDS_RETRIEVAL``."""
    out = []
    for p in prompts:
        lines = [line.strip() for line in p.strip().split("\n")]
        seen = [i for i, line in enumerate(lines[:-2]) if line == lines[-1]]
        out.append(re.sub(r"^\w+:\s*", "", lines[seen[-1] + 1]) if seen else "NEEDS_RETRIEVAL")
    return out


@task
def language(prompts: list[str]) -> list[str]:
    """The language whose commonest words a text has most of, else empty."""
    common = {"en": {"the", "and", "of", "to", "is"}, "de": {"der", "die", "und", "ist", "das"}, "fr": {"le", "les", "et", "est", "des"}, "es": {"el", "los", "y", "es", "que"}}
    out = []
    for p in prompts:
        words = re.findall(r"\w+", p.lower())
        best = max(common, key=lambda k: sum(w in common[k] for w in words))
        out.append(best if any(w in common[best] for w in words) else "")
    return out


@task
def caption(prompts: list[str]) -> list[str]:
    """A caption that names the image's file."""
    return [f"Image {p.rsplit('/', 1)[-1]}" for p in prompts]


def embed(texts: list[str], dim: int = 64) -> np.ndarray:
    """Hashed bag of words, unit length."""
    out = np.zeros((len(texts), dim), dtype=np.float32)
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", (t or "").lower()):
            h = zlib.crc32(w.encode())
            out[i, h % dim] += 1 if h >> 31 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def call(rows: DataFrame, prompt: str, reply: str, name: str, client: Task | None = None) -> DataFrame:
    """``rows`` with the replies of a task to the ``prompt`` column; null prompts have null replies."""
    run_task = client or TASKS[name]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = pdf[prompt].notna()
            out = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            if known.any():
                out[known] = run_task(pdf.loc[known, prompt].tolist())
            yield pdf.assign(**{reply: out})

    return rows.mapInPandas(run, f"{fields}, `{reply}` string")


def embedded(rows: DataFrame, text: str, vector: str, dim: int = 64) -> DataFrame:
    """``rows`` with the stand-in embedding of a text column."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{vector: list(embed(pdf[text].tolist(), dim))})

    return rows.mapInPandas(run, f"{fields}, `{vector}` array<float>")


def embedded_by_model(rows: DataFrame, text: str, vector: str, model: str, clients: dict[str, Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """``rows`` with the embedding of a text column by the model that each row names: a call for each model of a batch.

    Rows of a model without a client, and null texts, have null vectors.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            for name, part in pdf[pdf[text].notna()].groupby(model):
                if name in clients:
                    for i, v in zip(part.index, clients[name](part[text].tolist()), strict=True):
                        out[i] = v
            yield pdf.assign(**{vector: out})

    return rows.mapInPandas(run, f"{fields}, `{vector}` array<float>")
