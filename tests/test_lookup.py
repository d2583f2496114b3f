import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import lookup


def tables(spark, n=600, classes=25):
    rng = np.random.default_rng(7)
    x = 4 * rng.standard_normal((classes, 12))[rng.integers(0, classes, 2 * n)] + rng.standard_normal((2 * n, 12))
    x[5] = x[n + 5] = 0
    rows = [(i, "ab"[i % 3 == 0], v.tolist(), i % 11 == 0) for i, v in enumerate(x)]
    rows[8] = (8, None, rows[8][2], False)
    rows[9] = (9, "a", None, False)
    df = spark.createDataFrame(rows, "id long, namespace string, vector array<double>, conversational boolean")
    # equal vectors, of which the newest counts
    twins = df.where(f"id = {n + 10}").withColumn("id", F.col("id") + 10_000)
    cache = df.where(f"id >= {n}").union(twins).select(F.col("id").alias("entry_id"), "namespace", "vector", (F.col("id") % 1000).alias("created"))
    return x, df.where(f"id < {n}").withColumnRenamed("id", "query_id"), cache


def plain(queries, cache, at_least):
    out = {}
    entries = [r for r in cache.collect() if r["vector"] is not None and r["namespace"] is not None]
    for q in queries.collect():
        found = []
        for e in entries:
            if q["vector"] is not None and not q["conversational"] and e["namespace"] == q["namespace"]:
                a, b = np.array(q["vector"]), np.array(e["vector"])
                norm = np.linalg.norm(a) * np.linalg.norm(b)
                s = round(float(a @ b / norm), 6) if norm else 0.0
                if s >= at_least:
                    found.append((s, e["created"], e["entry_id"]))
        if found:
            s, _, e = max(found)
            out[q["query_id"]] = (e, s)
    return out


@pytest.mark.parametrize("at_least", [0.95, 0.25, -0.5])
def test_lookup_equals_all_pairs(spark, monkeypatch, at_least):
    monkeypatch.setattr(lookup, "ENTRIES", 40)  # rings are cut into blocks
    monkeypatch.setattr(lookup, "QUERIES", 30)
    _, queries, cache = tables(spark)
    got = {r["query_id"]: (r["entry_id"], r["similarity"]) for r in lookup.cache_lookup(queries, cache, at_least).collect()}
    want = plain(queries, cache, at_least)
    assert got.keys() == want.keys() and all(got[q][0] == e and abs(got[q][1] - s) < 2e-6 for q, (e, s) in want.items())


def test_a_high_threshold_compares_few(spark):
    _, queries, cache = tables(spark)
    compared = lambda t: lookup.compared_rings(queries, cache, t).agg(F.sum("compared")).first()[0]
    everything = compared(-1.0)
    asked, held = queries.where("not conversational and vector is not null"), cache.where("vector is not null")
    assert everything == asked.join(held.drop("vector"), "namespace").count()
    assert compared(0.95) < everything / 4
    assert lookup.cache_lookup(queries, cache.limit(0)).count() == 0 and lookup.cache_lookup(queries.limit(0), cache).count() == 0
