"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on the document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.bpe import WordEncoder, held_encoder, vocabulary
from quillspark.llm.common import bounded_batches, materialize, shared_path, table

#: Stripes are the unit of parallel reads; an index entry covers INDEX_ROWS rows.
STRIPE_BYTES = 32 << 20
INDEX_ROWS = 1000
#: Tokens of one record batch on the way to the writer.
BATCH_TOKENS = 2_000_000
SCHEMA = "doc_id long, part int, local_start long, ids array<int>"


def _token_batches(vocab, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = held_encoder(("word", len(vocab.value)), lambda: WordEncoder(vocab.value))
        start, doc_ids, parts, ids, held = 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal start
            sizes = np.array([len(i) for i in ids], dtype=np.int64)
            ends = np.cumsum(sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(np.concatenate(ids)))
            out = pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(start + ends - sizes), lists],
                names=["doc_id", "part", "local_start", "ids"],
            )
            start += int(ends[-1])
            return out

        for batch in batches:
            keys, places = batch.column("doc_id").to_pylist(), batch.column("part").to_pylist()
            for key, place, one in zip(keys, places, encode(batch.column("text")), strict=True):
                doc_ids.append(key)
                parts.append(place)
                ids.append(np.append(one.astype(np.int32), np.int32(end_id)))
                held += len(one) + 1
                if held >= BATCH_TOKENS:
                    yield flush()
                    doc_ids, parts, ids, held = [], [], [], 0
        if ids:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, vocab_path: str, end_id: int) -> None:
    """Write the ids of ``docs`` (doc_id, text) as ORC at ``path``, files and rows in ascending doc_id order.

    The texts, not the longer ids, are dealt out by ranges of doc_id; each task encodes its range and writes a file
    whose rows hold doc_id, the file's number, the ids before the row in that file, and the ids with ``end_id`` last.
    Null doc_ids come first, rows of one doc_id in the order of their texts' hashes; a null text has the end id only.
    An empty table writes no rows; no other column, whatever its name, is read.
    """
    bounded_batches(docs.sparkSession)
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary(vocab_path))
    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    dealt = dealt.withColumn("part", F.spark_partition_id())
    options = {
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(INDEX_ROWS),
        "orc.stripe.size": str(STRIPE_BYTES), "orc.create.index": "true", "compression": "zstd",
    }
    dealt.mapInArrow(_token_batches(vocab, end_id), SCHEMA).write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows; filters on doc_id reach the stripes' statistics, indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values = np.asarray(lists.values).astype("<u4", copy=False)
        ends = np.asarray(lists.offsets)
        crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), batch.column("local_start"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"],
        )


def token_index(tokens: DataFrame) -> DataFrame:
    """Where each document of the written rows stands: (doc_id, start, n_tokens, ids_crc32).

    ``start`` counts the ids of all documents before it: those in its file, and the totals of the files before.
    Repeated rows are counted one by one; files without rows give none.
    """
    rows = tokens.mapInArrow(_digests, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    rows = materialize(rows, "token-index")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per file
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op5_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's ids stand in the written files. Cases as in ``write_tokens`` and ``token_index``."""
    import public_tokenizers

    path = shared_path(spark, "tokens-orc")
    write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"), 1)
    return token_index(read_tokens(spark, path))
