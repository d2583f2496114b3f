"""Best-fit decreasing packing of token pieces, planned over lengths with a segment tree of remaining capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.bpe import ByteEncoder, held_encoder, vocabulary
from quillspark.llm.common import bounded_batches, materialize, table

CAPACITY = 2048
#: Pieces of one length that are numbered together.
NUMBERED = 250
END_ID = 0


class CapacityTree:
    """Segment tree over the capacities 0..top that answers the smallest capacity >= n with an open bin."""

    def __init__(self, top: int) -> None:
        self.size = 1 << top.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, bins: int) -> None:
        i = capacity + self.size
        while i:
            self.open[i] += bins
            i >>= 1

    def tightest(self, n: int) -> int | None:
        i = n + self.size
        while not self.open[i]:  # up to the first subtree on the right that has a bin
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:  # and down to its leftmost leaf
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.size


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over ``counts`` of pieces by length.

    Pieces of a length are alike, so the plan says where their running numbers go: rows (length, first, last + 1,
    bin, per, offset) put number k into bin + (k - first) // per at offset + ((k - first) % per) * length. As the
    tightest bin stays the tightest while it holds another piece of that length, each takes all it can in one step.
    There are at most ``capacity`` lengths, so the work and the plan don't grow with the number of pieces.
    """
    tree = CapacityTree(capacity)
    ranges: dict[int, list[tuple[int, int]]] = {}  # (first bin, number of bins) by remaining capacity
    out, bins = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            ranges.setdefault(left, []).append((first, n))
            tree.add(left, n)

    for length in sorted(counts, reverse=True):
        at, count = 0, counts[length]
        while at < count:
            room = tree.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                first, n = bins, -(-(count - at) // per)
                bins += n
            else:
                per = room // length
                first, n = ranges[room].pop()
                tree.add(room, -n)
            full = min(n, (count - at) // per)
            if full:
                out.append((length, at, at + full * per, first, per, capacity - room))
                put(room - per * length, first, full)
                at += full * per
            if full < n and at < count:  # one bin gets the rest
                rest = count - at
                out.append((length, at, count, first + full, per, capacity - room))
                put(room - rest * length, first + full, 1)
                at, full = count, full + 1
            put(room, first + full, n - full)
    return out


def _pieces(vocab, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = held_encoder(("byte", len(vocab.value)), lambda: ByteEncoder(vocab.value))
        for batch in batches:
            doc_id, piece, start, length, crc = [], [], [], [], []
            for key, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
                ids = np.append(ids, end_id).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    doc_id.append(key)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_id, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pack(docs: DataFrame, vocab_path: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pack the token ids of ``docs`` (doc_id, text), ``end_id`` last, into sequences of at most ``capacity`` ids.

    The ids are those of the tokenizers file, strings of its special tokens in a text included.
    Rows per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A longer document is cut into
    pieces of ``capacity``, the first of which may be shorter. Best-fit decreasing over all pieces: the driver gets
    only the counts by length. A null or empty text is its end id alone; rows that share or lack a doc_id are packed
    one by one; an empty table gives no rows; no other column, whatever its name, is read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    vocab = spark.sparkContext.broadcast(vocabulary(vocab_path))
    pieces = docs.select("doc_id", "text").mapInArrow(
        _pieces(vocab, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )
    pieces = materialize(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # running numbers within a length: groups of bounded size, after the counts of the groups before
    groups = F.array(*[F.lit(-(-counts.get(i, 1) // NUMBERED)) for i in range(1, capacity + 1)])
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(groups, F.col("length").cast("int")))
    pieces = pieces.withColumn("salt", salt)
    by_length = Window.partitionBy("length").orderBy("salt")
    before = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = before.select("length", "salt", (F.sum("n").over(by_length) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = pieces.withColumn("k", F.row_number().over(within)).join(before, ["length", "salt"])
    numbered = numbered.withColumn("k", F.col("before") + F.col("k") - 1)
    steps = spark.createDataFrame(plan(counts, capacity), "length long, first long, last long, bin long, per long, at long")
    # the plan's size is bounded by the number of lengths
    placed = numbered.join(F.broadcast(steps), "length").where("k >= first and k < last")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.expr("bin + (k - first) div per").alias("sequence_id"), F.expr("at + ((k - first) % per) * length").alias("offset"),
    )


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all texts of ``docs`` with their places; the tokenizer's end id is 0. Cases as in ``pack``."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of ``documents`` in sequences of 2048 ids. Cases as in ``pack``."""
    return packing_stage(spark, table(spark, sf_dir, "documents", "doc_id", "text"), sf_dir)
