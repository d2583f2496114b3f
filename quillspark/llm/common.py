"""Helpers shared by the training-data operators: reading tables, shared-folder tables, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.tables import shared_dir, shared_path, staged

__all__ = ["bounded_batches", "components", "materialize", "shared_dir", "shared_path", "shuffle_parts", "table"]

#: Write a table to the shared folder under a name and read it back: cuts the lineage, survives lost executors.
materialize = staged


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of ``sf_dir`` with the given columns only, so extra columns never reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of the rows that go to a Python worker at once; a longer row goes alone.
BATCH_BYTES = 8 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches of texts in Python workers by bytes, as ten thousand long texts would not fit; a value that the
    cluster's configuration gives is kept."""
    if not spark.sparkContext.getConf().contains(_BATCHES):
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


#: Edges that one task of a components round writes.
_EDGES = 20_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, component), component the smallest node.

    Alternates large-star and small-star steps until a round changes nothing. Every step is a partial
    aggregate per node plus a join, so a hub is never gathered; each round is a table in the shared folder.
    """
    parts = shuffle_parts(edges.sparkSession)
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    parts = min(parts, 1 + now.count() // _EDGES)  # as few files as the edges need; they never grow in number
    seen = None
    while True:
        # large-star: each node links its larger neighbours to the smallest node near it
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = (
            now.select(F.col("b").alias("k"), F.col("a").alias("v"))
            .union(now.select(F.col("a").alias("k"), F.col("b").alias("v")))
            .where("v > k")
            .join(least, "k")
            .select(F.col("v").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        large = materialize(large.coalesce(parts), "large")
        # small-star: each node and its smaller neighbours link to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")
        )
        now = materialize(small.select("e.*").where("a <> b").distinct().coalesce(parts), "edges")
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen:
            break
        seen = mark
    roots = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
