"""Training-pair datasets from feedback, judgments and search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.predicates import non_answer
from quillspark.tables import staged


def preference_pairs(feedback: DataFrame) -> DataFrame:
    """(prompt, chosen, rejected): liked answers against disliked or unrated ones to the same question, distinct."""
    liked = feedback.where((F.col("rating") == "like") & ~non_answer(F.col("answer"))).select(F.col("question").alias("prompt"), F.col("answer").alias("chosen")).distinct()
    other = feedback.where("rating in ('dislike', 'unknown') and trim(answer) <> ''").select(F.col("question").alias("prompt"), F.col("answer").alias("rejected")).distinct()
    return liked.join(other, "prompt").where("chosen <> rejected")


def random_negatives(positives: DataFrame, n: int, seed: int = 42, buckets: int = 64) -> DataFrame:
    """``n`` chunks per query of (query_id, chunk_id), each a positive of other queries and none of its own.

    Each query meets the chunks of a few hash buckets only, never all pairs: with N chunks, buckets of about n + 8
    more than its own positives are drawn in turn from the seed. Order by hash of seed, query and chunk. The few
    queries whose buckets held too little meet all chunks, so fewer than ``n`` means that there are no more.
    """
    pool = positives.select("chunk_id").distinct()
    total = pool.count()
    parts = max(1, min(buckets * 1024, total // (4 * (n + 8))))
    own = positives.groupBy("query_id").agg(F.count("*").alias("own"))
    # as many buckets as hold the wanted number besides all of the query's own
    wanted = F.least(F.lit(parts), F.ceil((F.col("own") + n + 8) * parts / F.lit(max(total, 1)) * 2).cast("int") + 1)
    asked = own.select("query_id", F.explode(F.sequence(F.lit(0), wanted - 1)).alias("i"))
    asked = asked.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "query_id") + F.col("i"), F.lit(parts)).cast("int")).select("query_id", "part")
    placed = pool.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int"))
    found = staged(asked.join(placed, "part").join(positives, ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id"))
    had = found.groupBy("query_id").agg(F.count("*").alias("had"))
    short = own.join(had, "query_id", "left").where((F.coalesce("had", F.lit(0)) < n) & (F.coalesce("had", F.lit(0)) < total - F.col("own")))
    every = short.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    rest = every.join(placed, "part").join(positives, ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id")
    found = found.join(short.select("query_id"), "query_id", "left_anti").unionByName(rest)
    order = Window.partitionBy("query_id").orderBy(F.xxhash64(F.lit(seed), "query_id", "chunk_id"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("query_id", "chunk_id", "rank")


def hard_negatives(hits: DataFrame, positives: DataFrame, n: int, floor: float = 0.3, ceiling: float = 0.85) -> DataFrame:
    """The ``n`` highest hits (query_id, chunk_id, score) with a cosine in the band that are no positives."""
    band = hits.where(F.col("score").between(floor, ceiling)).join(positives, ["query_id", "chunk_id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return band.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("query_id", "chunk_id", "score", "rank")


def reranker_rows(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """(query_id, chunk_id, label): positives 1, negatives 0."""
    return positives.select("query_id", "chunk_id", F.lit(1).alias("label")).unionByName(negatives.select("query_id", "chunk_id", F.lit(0).alias("label")))


def triplets(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """(query_id, positive, negative): the i-th positive with negative i modulo their number; none without negatives."""
    place = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(c)) - 1
    p = positives.select("query_id", F.col("chunk_id").alias("positive")).withColumn("i", place("positive"))
    q = negatives.select("query_id", F.col("chunk_id").alias("negative"), "rank").withColumn("j", place("rank"))
    n = q.groupBy("query_id").agg(F.count("*").alias("n"))
    return p.join(n, "query_id").withColumn("j", F.col("i") % F.col("n")).join(q, ["query_id", "j"]).select("query_id", "positive", "negative")


def prompt_pool(feedback: DataFrame, golden: DataFrame) -> DataFrame:
    """Prompts of both (prompt, seq), feedback first, each once at its first place."""
    both = feedback.select("prompt", "seq", F.lit(0).alias("source_no")).unionByName(golden.select("prompt", "seq", F.lit(1).alias("source_no")))
    return both.groupBy("prompt").agg(F.min(F.struct("source_no", "seq")).alias("first")).select("prompt", "first.source_no", "first.seq")


def without(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct ``rows`` whose keys ``known`` lacks; null keys count as equal."""
    same = [rows[k].eqNullSafe(known[k]) for k in keys]
    return rows.distinct().join(known, same, "left_anti")
