"""Shards cut from a Hilbert curve through the documents' metadata."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from quillspark.llm.common import materialize, table

SHARDS = 40
#: Bits of each metadata dimension on the curve.
BITS = 8


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of integer points (row, dimension) with ``bits`` bits each.

    After J. Skilling, "Programming the Hilbert curve" (2004): undo the excess work of the axes from the highest bit
    down, Gray-encode, and interleave the bits of the transposed index.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            t = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ t)
            x[i] = x[i] if i == 0 else x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


@F.pandas_udf(LongType())
def _hilbert(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.stack([a.to_numpy(), b.to_numpy(), c.to_numpy()], axis=1)))


def hilbert_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Cut ``docs`` (doc_id, text, lang, source) into ``shards`` runs of the Hilbert curve, counts at most one apart.

    The dimensions are the language, the source (each by the low bits of its CRC, null as 0) and the size in eighths
    of an octave; rows are ordered by curve index, then text CRC and doc_id, so equal texts of like metadata are
    neighbours. Rows: doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law ``rows``, shard, slot (gapless
    from 0 in the shard), grown_shard (null for this law), hilbert. A null text has size 16 and the CRC 0 of nothing.
    With fewer rows than shards some shards stay empty; an empty table gives no rows; repeated rows are placed one by
    one, and no other column, whatever its name, is read. Only narrow columns are sorted.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    byte = lambda c: F.coalesce(F.crc32(F.col(c)) % (1 << BITS), F.lit(0))
    keyed = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), byte("lang").alias("a"), byte("source").alias("b"))
    octave = F.least(F.floor(F.log2("size") * 8), F.lit((1 << BITS) - 1)).cast("long")
    keyed = keyed.withColumn("hilbert", _hilbert("a", "b", octave)).drop("a", "b")
    # distinct rows of the whole key are dealt out by its ranges, each counted within its part
    order = ["hilbert", "text_crc32", "doc_id", "size"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    mark = F.monotonically_increasing_id()  # the part in the high bits, the place in it in the low 33
    dealt = materialize(dealt.withColumn("mark", mark).select("*", F.shiftright("mark", 33).alias("part")), "curve")
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # one row per part
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    before = before.crossJoin(F.broadcast(parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))))  # one row
    rank = F.col("before") + F.col("mark").bitwiseAND((1 << 33) - 1)
    ranked = dealt.join(before, "part").withColumn("rank", rank)
    shard = F.expr(f"(rank * {shards}) div total")
    # the first rank r with r * shards div total = shard
    first = F.expr(f"(shard * total + {shards} - 1) div {shards}")
    return ranked.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 40 shards by law ``rows``. Cases as in ``hilbert_shards``."""
    return hilbert_shards(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
