"""Ingestion and retrieval as single plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillspark.functions.text import assembled_prompt
from quillspark.operators import chunk, context, dedup, search
from quillspark.plans.models import embedded
from quillspark.tables import staged


def ingest(docs: DataFrame, redact: bool = True, counts: Observation | None = None) -> DataFrame:
    """Chunks (chunk_id, doc_id, parent_id, source_name, text, vector) of ``docs`` (doc_id, text, source): redact, keep first copies, split, embed.

    ``counts`` takes the numbers of ``observed_first`` on the way.
    """
    clean = dedup.redacted(docs.select("doc_id", "text", "source"), enabled=redact)
    unique = (dedup.exact_first(clean) if counts is None else observed_first(clean, counts)).select("doc_id", "text", "source")
    sections = unique.select("doc_id", "source", F.lit(0).alias("section_no"), "text")
    leaves = chunk.tree(sections).where("level = 'paragraph'").select(F.xxhash64("node_id").alias("chunk_id"), "doc_id", "parent_id", "text")
    return embedded(leaves.join(unique.select("doc_id", F.col("source").alias("source_name")), "doc_id"), "text", "vector")


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = 20, cut: int = 5, budget: int = 8192) -> DataFrame:
    """Prompts (query_id, prompt, chunk_ids): hybrid search, cut, order by position, budget and assembly."""
    hits = search.hybrid(queries, chunks, k).where(F.col("rank") <= cut)
    texts = hits.join(chunks.select("chunk_id", "source_name", "text"), "chunk_id")
    placed = context.position_order(texts).withColumn("rank", F.col("position"))
    kept = context.within_budget(placed, budget)
    items = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "source_name", F.lit(None).cast("string").alias("ingestion_ts"), "text")))
    out = kept.groupBy("query_id").agg(items.alias("items"))
    return out.select("query_id", assembled_prompt(F.col("items")).alias("prompt"), F.transform("items", lambda x: x["chunk_id"]).alias("chunk_ids"))


def context_items(hits: DataFrame, nodes: DataFrame, texts: DataFrame, replies: DataFrame | None = None, cut: int = 5, budget: int = 8192, windows: DataFrame | None = None) -> DataFrame:
    """Context of ranked ``hits`` (query_id, chunk_id, rank, score): parents in place of their first hits (``nodes``:
    node_id, parent_id), texts (chunk_id, text) or the texts around them (``windows``: chunk_id, surrounding_text), a
    model's order (``replies``: query_id, reply), the first ``cut``, order by position, and the budget.
    """
    rows = context.expand_parents(hits, nodes).join(texts, "chunk_id")
    if windows is not None:
        rows = rows.join(windows, "chunk_id", "left").withColumn("text", F.coalesce("surrounding_text", "text")).drop("surrounding_text")
    # places are counted anew, as a parent without a text is left out
    if replies is not None:
        rows = search.listed_order(rows, replies)
    else:
        rows = search.reranked(rows.withColumn("order", F.array().cast("array<int>"))).drop("order")
    placed = context.position_order(rows.where(F.col("rank") <= cut)).withColumn("rank", F.col("position"))
    return context.within_budget(placed, budget)


def observed_first(docs: DataFrame, counts: Observation) -> DataFrame:
    """``exact_first`` of ``docs``, written once; meanwhile ``counts`` takes the documents scanned, those kept as first of
    their text, and those skipped. A kept row knows its copies, so that nothing is read a second time for them."""
    kept = dedup.exact_first(docs)
    scanned, indexed = F.coalesce(F.sum("copies"), F.lit(0)), F.count(F.lit(1))
    return staged(kept.observe(counts, scanned.alias("scanned"), indexed.alias("indexed"), (scanned - indexed).alias("skipped")), "first-copies")


def ingest_counts(docs: DataFrame) -> DataFrame:
    """One row (scanned, indexed, skipped) of what ``observed_first`` counts."""
    counts = Observation("ingest")
    observed_first(docs, counts)
    return docs.sparkSession.createDataFrame([tuple(counts.get[c] for c in ("scanned", "indexed", "skipped"))], "scanned long, indexed long, skipped long")
