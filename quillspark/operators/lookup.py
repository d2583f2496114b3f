"""The most similar entry of a namespace above a threshold, without comparing all pairs: pivots and angles.

Entries are dealt to the pivot they are nearest to and to rings of like angles around it. As angles obey the triangle
inequality, a query skips each ring whose angles differ from its own angle to that pivot by more than the threshold's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.tables import staged

#: Pivots at most (they and nothing else of the entries are broadcast), the width of a ring in radians.
PIVOTS, RING = 32, 0.1
#: Entries, and queries, that meet in one task.
ENTRIES, QUERIES = 4000, 1000
#: What angles and rounded similarities may be off by.
_SLACK = 2e-6


def _units(column) -> np.ndarray:
    """Vectors as rows of length 1; a zero vector stays zero, at a right angle to all."""
    x = np.array(list(column), dtype=np.float64).reshape(len(column), -1)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _dealt(pivots):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                angles = _angles(_units(pdf["vector"]), pivots.value)
                cell = angles.argmin(1)
                angle = angles[np.arange(len(pdf)), cell]
                yield pdf.assign(cell=cell, ring=(angle / RING).astype(np.int64), angle=angle)

    return run


def _asking(pivots):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(angles=list(_angles(_units(pdf["qv"]), pivots.value)))

    return run


def _best(at_least: float):
    def run(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(entries):
            scores = np.round(_units(queries["qv"]) @ _units(entries["vector"]).T, 6) + 0.0
            order = list(zip(entries["created"], entries["entry_id"], strict=True))
            for query, score in zip(queries["query_id"], scores, strict=True):
                top = score.max()
                best = max((order[i] for i in np.flatnonzero(score == top)), default=None) if top >= at_least else None
                created, entry = best or (None, None)
                out.append((query, entry, created, top if best else None, len(entries)))
        return pd.DataFrame(out, columns=["query_id", "entry_id", "created", "similarity", "compared"])

    return run


def compared_rings(queries: DataFrame, cache: DataFrame, at_least: float) -> DataFrame:
    """A row per query and block of entries that it was compared with: the best entry there that reaches ``at_least``,
    if any, and how many were ``compared``. Columns as ``cache_lookup`` takes them; ``created`` and ids aren't null."""
    spark = cache.sparkSession
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    asked = queries.where("not conversational and vector is not null").select("query_id", F.col("namespace").cast("string").alias("namespace"), F.col("vector").cast("array<double>").alias("qv"))
    held = cache.where("vector is not null").select("entry_id", F.col("namespace").cast("string").alias("namespace"), "created", F.col("vector").cast("array<double>").alias("vector"))
    chosen = held.orderBy(F.xxhash64("entry_id"), "entry_id").limit(PIVOTS).toPandas()
    found = f"query_id {kind(queries, 'query_id')}, entry_id {kind(cache, 'entry_id')}, created {kind(cache, 'created')}, similarity double, compared long"
    if not len(chosen):
        return spark.createDataFrame([], found)
    pivots = spark.sparkContext.broadcast(_units(chosen["vector"]))
    entries = f"entry_id {kind(cache, 'entry_id')}, namespace string, created {kind(cache, 'created')}, vector array<double>, cell long, ring long, angle double"
    dealt = staged(held.mapInPandas(_dealt(pivots), entries), "entries")
    wanted = staged(asked.mapInPandas(_asking(pivots), f"query_id {kind(queries, 'query_id')}, namespace string, qv array<double>, angles array<double>"), "queries")
    # a few hundred rings a namespace at most
    rings = dealt.groupBy("namespace", "cell", "ring").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.ceil(F.count("*") / ENTRIES).cast("int").alias("blocks"))
    rings = staged(rings, "rings")
    angle = F.get("angles", F.col("cell").cast("int"))
    widest = float(np.arccos(np.clip(at_least - _SLACK, -1, 1))) + _SLACK
    visits = wanted.join(rings, "namespace").where((F.col("low") - angle <= widest) & (angle - F.col("high") <= widest))
    visits = staged(visits.select("query_id", "namespace", "cell", "ring", "blocks"), "visits")
    ring = ["namespace", "cell", "ring"]
    crowds = visits.groupBy(*ring).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("crowds"), F.max("blocks").alias("blocks"))
    crowds = staged(crowds, "crowds")
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.drop("blocks").join(crowds, ring).withColumn("crowd", part("query_id", "crowds")).withColumn("block", each("blocks"))
    left = left.select("query_id", *ring, "crowd", "block").join(wanted.select("query_id", "qv"), "query_id")
    right = dealt.drop("angle").join(crowds, ring).withColumn("block", part("entry_id", "blocks")).withColumn("crowd", each("crowds"))
    key = [*ring, "crowd", "block"]
    return left.groupBy(*key).cogroup(right.select("entry_id", "created", "vector", *key).groupBy(*key)).applyInPandas(_best(at_least), found)


def cache_lookup(queries: DataFrame, cache: DataFrame, at_least: float = 0.95) -> DataFrame:
    """The most similar cache entry of the namespace at or above the threshold; ties to the newest, then the greatest id.

    ``queries``: (query_id, namespace, vector, conversational), ``cache``: (entry_id, namespace, vector, created). A
    query_id is a key. Conversational queries are not looked up, and rows without a namespace or vector meet nothing.
    Similarities are cosines of six decimals, 0 with a zero vector. Expired entries are the caller's filter.
    """
    hit = compared_rings(queries, cache, at_least).where("similarity is not null")
    hit = hit.groupBy("query_id").agg(F.max(F.struct("similarity", "created", "entry_id")).alias("h"))
    return hit.select("query_id", "h.entry_id", "h.similarity")
