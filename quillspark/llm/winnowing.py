"""Benchmark decontamination by winnowing: fingerprints of both sides are joined, hits extended word by word.

A text's fingerprints are the smallest hashes of K consecutive words within every SPAN consecutive words (the last of
equal ones). Two texts that share SPAN words choose the same place in them, so each shared span has a common fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.bpe import slices
from quillspark.llm.common import bounded_batches, materialize, shared_path, table
from quillspark.llm.textsets import word_hashes

#: Words of a window of the benchmark, and of a hashed gram.
SPAN, K = 10, 5
#: Bits of the filter of fingerprints that is broadcast (16 MB whatever the benchmark), and of its blocks.
FILTER_BITS, BLOCK_BITS = 27, 17
#: Parts over which the rows of one fingerprint are spread.
SPREAD = 16
#: Bytes of the texts that are hashed together.
BATCH_BYTES = 2_000_000

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _grams(words: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; those of different ``salt`` never mean the same."""
    n = max(0, len(words) - k + 1)
    h = np.full(n, salt, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = (h ^ words[j : j + n]) * _MULT
            h ^= h >> np.uint64(29)
    return h


class Batch:
    """The words of some texts, and their fingerprints."""

    def __init__(self, buffers: list) -> None:
        data = b"\n".join(buffers) + b"\n"
        self.hashes, starts, ends = word_hashes(np.frombuffer(data, dtype=np.uint8), _WORD)
        self.low = data.translate(_LOWER)
        self.starts, self.ends = starts, ends
        stops = np.cumsum([len(b) + 1 for b in buffers])
        #: The first word of each text, and one past the last text's.
        self.firsts = np.concatenate(([0], np.searchsorted(starts, stops)))
        self.counts = np.diff(self.firsts)
        self.text_of = np.repeat(np.arange(len(buffers)), self.counts)

    def whole(self, n: int) -> np.ndarray:
        """Whether the ``n`` words from each place are of one text."""
        m = max(0, len(self.text_of) - n + 1)
        return self.text_of[:m] == self.text_of[n - 1 : n - 1 + m]

    def winnowed(self, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes): the smallest gram of every ``span`` words of one text, the last of equal ones."""
        h = _grams(self.hashes, k, span)
        wide = span - k + 1
        if len(h) < wide:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        windows = np.lib.stride_tricks.sliding_window_view(h, wide)
        chosen = np.arange(len(windows)) + wide - 1 - windows[:, ::-1].argmin(axis=1)
        places = np.unique(chosen[self.whole(span)])
        return places, h[places]

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of all runs of ``n`` words of one text."""
        places = np.flatnonzero(self.whole(n))
        return places, _grams(self.hashes, n, n)[places]

    def around(self, place: int, k: int, reach: int) -> tuple[int, str]:
        """The first word taken, counted within its text, and the words up to ``reach`` before and after the gram."""
        text = self.text_of[place]
        a, b = max(self.firsts[text], place - reach), min(self.firsts[text + 1], place + k + reach)
        words = [self.low[x:y] for x, y in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist(), strict=True)]
        return int(a - self.firsts[text]), b" ".join(words).decode()


def _batches(texts: pa.Array) -> Iterator[tuple[int, Batch]]:
    """Runs of ``texts`` of bounded size, read where Arrow holds them: the first text's number, and the words."""
    texts = pc.fill_null(texts, "")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    for a, b in slices(texts, BATCH_BYTES):
        part = texts.slice(a, b - a)
        _, offsets, data = part.buffers()
        at = np.frombuffer(offsets, dtype=wide)[part.offset : part.offset + len(part) + 1].tolist()
        held = memoryview(data or b"")
        yield a, Batch([held[x:y] for x, y in zip(at[:-1], at[1:], strict=True)])


_FOUND = "array<struct<hash:long,size:int,skip:int,first:int,words:string>>"


def _listed(batch: Batch, picked: list[tuple[np.ndarray, np.ndarray, int, int]]) -> list[list[dict]]:
    """For each text the fingerprints picked, as (places, hashes, words of the window, words of the gram)."""
    out: list[list[dict]] = [[] for _ in batch.counts]
    for places, hashes, size, k in picked:
        for place, h in zip(places.tolist(), hashes.view(np.int64).tolist(), strict=True):
            first, words = batch.around(place, k, size - k)
            text = int(batch.text_of[place])
            out[text].append({"hash": h, "size": size, "skip": place - int(batch.firsts[text]) - first, "first": first, "words": words})
    return out


def _item_prints(span: int, k: int):
    """Fingerprints of each item: winnowed for items of a whole window, else the item itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, words in _batches(batch.column("text")):
                places, hashes = words.winnowed(span, k)
                picked = [(places, hashes, span, k)]
                for n in set(words.counts.tolist()) - {0}:
                    if n < span:
                        at = words.firsts[:-1][words.counts == n]
                        picked.append((at, _grams(words.hashes, n, n)[at], n, n))
                ids = batch.column("item_id").slice(a, len(words.counts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(_listed(words, picked), _ARROW)], names=["item_id", "found"])

    return run


_ARROW = pa.list_(pa.struct([("hash", pa.int64()), ("size", pa.int32()), ("skip", pa.int32()), ("first", pa.int32()), ("words", pa.string())]))


def _doc_prints(filter_, short: list[int], span: int, k: int):
    """Number of words, and the fingerprints that the filter holds, of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(filter_.value, dtype=np.uint8)

        def held(places, hashes):
            at = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            return places[hit], hashes[hit]

        for batch in batches:
            for a, words in _batches(batch.column("text")):
                picked = [(*held(*words.winnowed(span, k)), span, k)] + [(*held(*words.runs(n)), n, n) for n in short]
                ids = batch.column("doc_id").slice(a, len(words.counts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(words.counts), pa.array(_listed(words, picked), _ARROW)], names=["doc_id", "n_words", "found"])

    return run


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(1 << BLOCK_BITS, dtype=bool)
    bits[pdf["bit"].to_numpy(np.int64)] = True
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def fingerprint_filter(prints: DataFrame) -> bytes:
    """A bit for each value of the upper FILTER_BITS of the hashes: blocks are made by tasks, and of one size however
    many fingerprints there are."""
    high = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    placed = prints.select(F.shiftright(high, BLOCK_BITS).alias("block"), high.bitwiseAND((1 << BLOCK_BITS) - 1).alias("bit")).distinct()
    out = np.zeros((1 << (FILTER_BITS - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), dtype=np.uint8)
    for r in placed.groupBy("block").applyInPandas(_block, "block long, bits binary").toLocalIterator():
        out[r["block"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.tobytes()


def shared_run(size: int, a: list[str], skip_a: int, b: list[str], skip_b: int) -> tuple[int, int] | None:
    """The places in ``a`` of the run of equal words around a hit, if it has ``size`` words; the hit stands ``skip_a``
    words into ``a`` and ``skip_b`` into ``b``."""
    left, right = 0, 0
    while left < min(skip_a, skip_b) and a[skip_a - left - 1] == b[skip_b - left - 1]:
        left += 1
    while skip_a + right < len(a) and skip_b + right < len(b) and a[skip_a + right] == b[skip_b + right]:
        right += 1
    return (skip_a - left, skip_a + right) if left + right >= size else None


def _extended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        known: dict[tuple, tuple | None] = {}  # copies of a passage meet an item with the same words each time
        out = []
        for row, item, size, first, a, i, b, j in zip(*[pdf[c].tolist() for c in ("row", "item_id", "size", "first", "words", "skip", "item_words", "item_skip")], strict=True):
            key = (size, a, i, b, j)
            if key not in known:
                known[key] = shared_run(size, a.split(" "), i, b.split(" "), j)
            if run := known[key]:
                out.append((row, item, first + run[0], first + run[1]))
        yield pd.DataFrame(out, columns=["row", "item_id", "a", "b"])


def contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """How much of each text of ``docs`` (doc_id, text) stands in ``benchmark`` (item_id, text).

    Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one per row of ``docs``: words, words within an
    occurrence of ``span`` consecutive words of an item (of all its words, if it has fewer), the items that so occur, and
    the SHA-256 of their ids, sorted as strings and joined by commas. Words are runs of ASCII letters, lower-cased,
    digits and characters beyond ASCII. Only fingerprints that a filter of the benchmark's lets through leave the tasks,
    each with the words around it; a match is decided by these words. Null and empty texts have no words and no hits.
    Repeated rows, and rows that share a doc_id or have none, are judged each by itself; items that share an item_id
    count as one, items without one mark words and aren't listed. Empty tables give no rows, or no hits. Other columns,
    whatever their names, are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = benchmark.schema["item_id"].dataType.simpleString()
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    prints = items.mapInArrow(_item_prints(span, k), f"item_id {kind}, found {_FOUND}").select("item_id", F.explode("found").alias("f")).select("item_id", "f.*")
    prints = materialize(prints, "item-prints")
    short = sorted(r["size"] for r in prints.where(F.col("size") < span).select("size").distinct().collect())  # below span
    shared = spark.sparkContext.broadcast(fingerprint_filter(prints))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(_doc_prints(shared, short, span, k), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, found {_FOUND}")
    path = shared_path(spark, "doc-prints")
    rows.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)  # numbered once, as written
    rows = spark.read.parquet(path)
    # a passage that many texts hold is one hash in many rows: those are spread, and the items' side repeated
    hits = rows.select("row", F.explode("found").alias("f")).select("row", "f.*").withColumn("part", F.pmod(F.hash("row"), F.lit(SPREAD)))
    asked = prints.select("item_id", "hash", "size", F.col("skip").alias("item_skip"), F.col("words").alias("item_words"))
    asked = asked.distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    met = hits.join(asked, ["hash", "size", "part"]).select("row", "item_id", "size", "first", "words", "skip", "item_words", "item_skip")
    runs = met.mapInPandas(_extended, f"row long, item_id {kind}, a int, b int")
    # of one text: its runs and its items
    merged = F.aggregate(
        F.array_sort("runs"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], s["end"]))).alias("n"), F.greatest(s["end"], r["b"]).alias("end")),
        lambda s: s["n"],
    )
    listed = runs.groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("runs"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    listed = listed.select("row", merged.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"))
    some = rows.where(F.size("found") > 0).select("doc_id", "n_words", "row").join(listed, "row", "left")
    none = rows.where(F.size("found") == 0).select("doc_id", "n_words", *[F.lit(None).cast(t).alias(c) for c, t in (("n_hit", "long"), ("n_items", "long"), ("items", "string"))])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return some.select(none.columns).unionByName(none).select(
        "doc_id", "n_words", zero("n_hit"), zero("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")
    )


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all of ``benchmark``. Cases as in ``contaminated``."""
    return contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op12_sql() -> str:
    up, low, word = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{up}', '{low}'), '{word}')"
    return rf"""
WITH items AS (SELECT item_id, {words} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {SPAN}) AS size, unnest(list_transform(range(1, len(w) - least(len(w), {SPAN}) + 2),
    lambda i: array_to_string(w[i:i + least(len(w), {SPAN}) - 1], ' '))) AS win FROM items WHERE len(w) > 0),
docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
spans AS (
  SELECT r, size, unnest(range(1, len(w) - size + 2)) AS i,
    unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS win
  FROM docs, sizes WHERE len(w) >= size),
hits AS (SELECT r, i, s.size, item_id FROM spans s JOIN windows v ON s.win = v.win AND s.size = v.size),
words_hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM hits)) GROUP BY r),
listed AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(l.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words_hit h ON d.r = h.r LEFT JOIN listed l ON d.r = l.r
"""
