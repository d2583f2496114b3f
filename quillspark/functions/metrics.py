"""Scalar measures: vectors, ranking, cost and rewards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import has_citation, words

# fixed values: (model, input price, output price) in dollars per million tokens
PRICES = (
    ("gpt-4-turbo", 10.00, 30.00),
    ("gpt-4o", 2.50, 10.00),
    ("gpt-4o-mini", 0.15, 0.60),
    ("text-embedding-3-small", 0.02, 0.0),
    ("text-embedding-3-large", 0.13, 0.0),
    ("BAAI/bge-large-en-v1.5", 0.0, 0.0),
)
FALLBACK_MODEL = "gpt-4-turbo"
RERANK_PER_1000 = 2.00


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def nearest_rank(values: Column, p: float) -> Column:
    """Nearest-rank percentile of an array of numbers: rank max(1, p/100 n rounded half to even); 0 of nothing."""
    n = F.size(values)
    rank = F.least(n, F.greatest(F.lit(1), F.bround(F.lit(p / 100.0) * n, 0).cast("int")))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.element_at(F.array_sort(values), rank))


def token_cost(model: Column, prompt: Column, completion: Column, prices=PRICES, fallback: str = FALLBACK_MODEL) -> Column:
    """Dollars of a call; unknown models cost as the fallback."""
    table = {m: (i, o) for m, i, o in prices}
    of = lambda k: F.coalesce(F.create_map(*[F.lit(x) for m, p in table.items() for x in (m, p[k])])[model], F.lit(table[fallback][k]))
    return (prompt * of(0) + completion * of(1)) / 1e6


def rerank_cost(n: Column, per_1000: float = RERANK_PER_1000) -> Column:
    return n * per_1000 / 1000


def length_reward(text: Column, target: int = 256, most: int = 512) -> Column:
    """Rises linearly to 1 at ``target`` words and falls to 0 at ``most``."""
    n = F.size(words(text))
    return F.when(n <= target, n / target).when(n >= most, F.lit(0.0)).otherwise(1 - (n - target) / (most - target))


def word_overlap(response: Column, context: Column) -> Column:
    """Share of the response's distinct words that the context has; 1 without context, 0 for an empty response."""
    of = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    said, known = of(response), of(context)
    return F.when(F.size(known) == 0, F.lit(1.0)).when(F.size(said) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(said, known)) / F.size(said))


def squashed(logit: Column) -> Column:
    return F.tanh(logit)


def reward(response: Column, context: Column, learned: Column | None = None, weights=(0.7, 0.15, 0.1, 0.05)) -> Column:
    """Weighted sum of the learned reward, citation, overlap and length; without a learned one its weight is shared out."""
    learned_w, *rest = weights
    scale = 1.0 if learned is not None else 1 / sum(rest)
    parts = (has_citation(response), word_overlap(response, context), length_reward(response))
    total = sum((F.lit(w * scale) * p for w, p in zip(rest, parts, strict=True)), F.lit(0.0))
    return total if learned is None else total + F.lit(learned_w) * squashed(learned)
