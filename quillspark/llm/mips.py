"""Exact inner-product top-k by norm buckets: per bucket, coordinate or length pruning from local cosine thresholds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, table
from quillspark.llm.vectors import asking, best, part_of, usable

SCALE = 1024
#: Buckets of like length, cut at approximate quantiles of all norms.
BUCKETS = 16
#: Vectors of one part of a bucket, and queries of one block.
PART, QUERIES = 4000, 8000
#: Long vectors that give each query its first threshold.
SEEDS = 2000
#: Above this local cosine threshold coordinates prune, below it lengths alone.
COSINE = 0.5
#: Coordinates of the query with the largest shares that are tested.
FOCUS = 4
_EXACT = 2.0**52


def _top(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        kth = np.partition(score, -k)[-k]
        rows = np.flatnonzero(score >= kth)
        return rows[np.lexsort((ids[rows], -score[rows]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _ints(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), -1)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of ``x`` with ``q``, in floating point where no sum can be rounded."""
    if len(x) and float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] < _EXACT:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return x @ q


class Bucket:
    """Vectors of like length, longest first, with what pruning needs."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        order = np.argsort(-norm, kind="stable")
        self.ids, self.x, self.norm = ids[order], x[order], norm[order]
        self.exact = float(np.abs(x).max()) if len(x) else 0.0
        self.floats = self.x.astype(np.float64)
        self.unit = self.floats / np.where(self.norm > 0, self.norm, 1)[:, None]

    def candidates(self, q: np.ndarray, threshold: float) -> np.ndarray:
        """Places of all vectors whose product with ``q`` may reach ``threshold``."""
        length = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        if not len(self.ids) or threshold == -np.inf or length == 0 or threshold <= 0:
            return np.arange(len(self.ids))
        slack = 1 - 1e-9
        local = threshold * slack / (length * self.norm[0]) if self.norm[0] else np.inf
        if local > 1:
            return np.empty(0, dtype=np.int64)  # length pruning of the whole bucket
        n = int(np.searchsorted(-self.norm, -threshold * slack / length, side="right"))
        if local < COSINE:
            return np.arange(n)
        # coordinate pruning: a unit vector with cosine >= local lies, in each coordinate, near the query's
        u = q / length
        rows = np.arange(n)
        for f in np.argsort(-np.abs(u))[:FOCUS]:
            wide = np.sqrt(max(0.0, (1 - local * local) * (1 - u[f] * u[f]))) + 1e-9
            c = self.unit[rows, f]
            rows = rows[(c >= local * u[f] - wide) & (c <= local * u[f] + wide)] if u[f] * u[f] < local * local else rows[np.abs(c) >= abs(local * u[f]) - wide]
        return rows

    def search(self, query: int, q: np.ndarray, threshold: float, k: int) -> list[tuple[int, int, int]]:
        rows = self.candidates(q, threshold)
        rows = rows[self.ids[rows] != query]
        if self.exact * float(np.abs(q).max(initial=0)) * max(1, len(q)) < _EXACT:
            score = (self.floats[rows] @ q.astype(np.float64)).astype(np.int64)
        else:
            score = self.x[rows] @ q
        keep = score >= threshold
        rows, score = rows[keep], score[keep]
        return [(query, int(self.ids[rows[j]]), int(score[j])) for j in _top(self.ids[rows], score, k)]


def _threshold(seeds, k: int):
    def run(batches):
        ids, x = seeds.value
        for pdf in batches:
            low = []
            for query, q in zip(pdf["query_id"].tolist(), _ints(pdf["q"]), strict=True):
                score = products(x, q)[ids != query]
                low.append(float(np.partition(score, -k)[-k]) if len(score) >= k else float("-inf"))
            yield pdf.assign(threshold=low)

    return run


def _search(k: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(vectors):
            bucket = Bucket(vectors["vec_id"].to_numpy(), _ints(vectors["q"]))
            for query, q, low in zip(queries["query_id"].tolist(), _ints(queries["q"]), queries["threshold"].tolist(), strict=True):
                out += bucket.search(query, q, low, k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def top_products(vectors: DataFrame, queries: Column, k: int, scale: int = SCALE) -> DataFrame:
    """For the rows of ``vectors`` (vec_id, embedding) where ``queries`` holds, the ``k`` rows of highest inner product.

    Components become floor(scale * x); scores are exact integers. Rows (query_id, rank, vec_id, score), ties to the
    smaller vec_id. A query's threshold is its k-th product with the SEEDS longest vectors, so nothing below it can
    be among its best; every bucket part is searched for it by the pruning its local cosine threshold suggests.
    Vectors null, empty or with null or non-finite components take no part; zero vectors do. All vectors must have
    one length and components within 2**31 / scale. Rows that share a vec_id are all candidates, none for queries of
    their own id, and the smallest vector asks. An empty table gives no rows. Other columns, whatever their names, are
    not read.
    """
    spark = vectors.sparkSession
    ints = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    rows = usable(vectors).select("vec_id", ints.alias("q"))
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = materialize(rows.withColumn("norm", norm), "integers")
    cuts = rows.agg(F.percentile_approx("norm", [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("c")).first()["c"] or []
    bucket = sum((F.when(F.col("norm") >= c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    rows = rows.withColumn("bucket", bucket)
    longest = rows.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).toPandas()
    seeds = spark.sparkContext.broadcast((longest["vec_id"].to_numpy(np.int64), _ints(longest["q"]) if len(longest) else np.empty((0, 1), dtype=np.int64)))
    asked = asking(rows, queries, "q")
    asked = materialize(asked.mapInPandas(_threshold(seeds, k), "query_id long, q array<long>, threshold double"), "thresholds")
    n_queries = asked.count()
    blocks = max(1, -(-n_queries // QUERIES))
    # a row per bucket; a bucket's parts are counted, not listed
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.max("norm").alias("longest")).collect()
    parts = F.array(*[F.struct(F.lit(r["bucket"]).alias("bucket"), F.lit(r["parts"]).alias("parts"), F.lit(r["longest"]).alias("longest")) for r in sizes]) if sizes else F.array().cast("array<struct<bucket:int,parts:int,longest:double>>")
    of = F.create_map(*[x for r in sizes for x in (F.lit(r["bucket"]), F.lit(r["parts"]))]) if sizes else F.create_map().cast("map<int,int>")
    length = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    left = asked.withColumn("block", part_of(F.col("query_id"), F.lit(blocks))).withColumn("length", length)
    left = left.withColumn("to", F.explode(parts)).where("threshold <= 0 or length * to.longest >= threshold * (1 - 1e-9)")
    left = left.select("query_id", "q", "threshold", "to.bucket", F.explode(F.sequence(F.lit(0), F.col("to.parts") - 1)).alias("part"), "block")
    right = rows.withColumn("part", part_of(F.col("vec_id"), of[F.col("bucket")])).select("vec_id", "q", "bucket", "part")
    right = right.withColumn("block", F.explode(F.array(*map(F.lit, range(blocks))) if blocks < 100 else F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["bucket", "part", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_search(k), "query_id long, vec_id long, score long")
    return best(found, k)


def op9_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer products of every 100th ``embeddings`` row. Cases as in ``top_products``."""
    return top_products(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0, 10)


def op9_sql() -> str:
    return """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM ok a, ok b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
