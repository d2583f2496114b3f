"""Corpus pipeline: language ID, near-duplicate removal, personal data, packing. Each stage reads what the last kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import materialize
from quillspark.llm.lid import language_stage
from quillspark.llm.ngram_join import ngram_classes
from quillspark.llm.packing import packing_stage
from quillspark.llm.pii import pii_stage

#: A near-duplicate stage takes five-word shingles and a similarity of 0.8.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: Ids of removed or repeated rows that may be broadcast (some 30 bytes each); more are shuffled with the texts.
BROADCAST_IDS = 4_000_000


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one whose doc_id names its class.

    Texts without words are in no group and stay, as do rows without a doc_id. Of rows that share the kept doc_id
    one stays. Rows and columns of those kept stay as they are.
    """
    classes = materialize(ngram_classes(docs, SHINGLE_WORDS, SIMILAR_PERCENT), "classes")
    counts = classes.where("doc_id is not null").groupBy("doc_id").agg(F.count_if(F.expr("doc_id = component_id")).alias("n"))
    others = counts.where("n <> 1").select("doc_id")
    if others.count() <= BROADCAST_IDS:  # so that the texts needn't be shuffled
        others = F.broadcast(others)
    kept = docs.where("doc_id is not null").join(others, "doc_id", "left_anti")
    # rows that share an id; apart, so that only these texts are aggregated
    repeated = docs.join(counts.where("n > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(repeated).unionByName(docs.where(F.col("doc_id").isNull()))


STAGES = [
    ("language_id", language_stage),
    ("ngram_join", near_duplicate_stage),
    ("pii_surrogates", pii_stage),
    ("best_fit_packing", packing_stage),
]

#: No SQL: a trained network, keyed draws and a tokenizer; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
