"""Near duplicates by MinHash signatures in bands: candidates share a band, and are checked on their whole gram sets.

The exact join is ``dedup.near_pairs``. Here a pair at the threshold of 0.85 shares one of 16 bands of 8 values with a
chance of 0.994, one at 0.9 of 0.9999; nothing below the threshold is ever returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import normalize
from quillspark.operators.dedup import dropped_greedily
from quillspark.operators.dedup import first_sets as _first_sets
from quillspark.operators.gramsets import by_size, gram_sets, grams, reaching, similar_pairs, unpacked  # noqa: F401
from quillspark.tables import staged

THRESHOLD, K = 0.85, 3
BANDS, ROWS = 16, 8
PERMUTATIONS = BANDS * ROWS
#: Members of a band that meet in one task; larger bands are cut into blocks, and each pair of blocks is a task.
BLOCK = 256
#: Rows of small bands that share a task.
GROUP_ROWS = 20_000
#: Rounds in which what has no earlier similar row drops what is similar to it, before all pairs that are left.
ROUNDS = 3
#: Signatures that agree in fewer places than the threshold by so much are no candidates: four standard deviations.
_SLACK = 4 * (THRESHOLD * (1 - THRESHOLD) / PERMUTATIONS) ** 0.5

_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def signature(codes: np.ndarray) -> np.ndarray:
    """The least value of each permutation over the grams."""
    out = np.full(PERMUTATIONS, np.iinfo(np.uint32).max, dtype=np.uint32)
    with np.errstate(over="ignore"):
        mixed = (codes ^ (codes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        for a in range(0, len(mixed), 2048):
            hashed = (mixed[a : a + 2048, None] * _A + _B) >> np.uint64(32)
            out = np.minimum(out, hashed.min(0).astype(np.uint32))
    return out


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """One number for each band of a signature."""
    h = np.zeros(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for column in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
            h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _code(codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The lowest byte of each place of the signature and the bands' numbers as bytes, and these numbers."""
    bands = band_hashes(sig := signature(codes))
    return sig.astype(np.uint8).tobytes() + bands.tobytes(), bands


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        codes = [_code(unpacked(g)) for g in pdf["g"]]
        yield pd.DataFrame({"id": pdf["id"], "sig": [s for s, _ in codes], "bands": [b for _, b in codes]})


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(id, t): one row of each normalised text of ``docs`` (id, text), its smallest id; null texts are one."""
    return docs.select("id", normalize(F.col("text")).alias("t")).groupBy("t").agg(F.min("id").alias("id")).select("id", "t")


def signatures(texts: DataFrame) -> DataFrame:
    """(id, sig, bands) of ``texts`` (id, t); those shorter than a gram have none."""
    return _signatures(gram_sets(texts, K))


def _signatures(sets: DataFrame) -> DataFrame:
    return sets.select("id", "g").mapInPandas(_signed, "id long, sig binary, bands array<long>")


def _members(signed: DataFrame) -> DataFrame:
    return signed.select("id", F.posexplode("bands").alias("band", "h"))


def _shared(members: DataFrame) -> DataFrame:
    """(band, h, id, n, first) of the bands that several rows share; tasks count before the shuffle."""
    several = members.groupBy("band", "h").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    return members.join(several, ["band", "h"])


def _alike(threshold: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, low, high = key
        pdf = pdf.sort_values(["band", "h", "id"], kind="stable")
        ids, block, band, h, crowd = (pdf[c].to_numpy() for c in ("id", "block", "band", "h", "crowd"))
        code = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint8).reshape(len(ids), -1)
        places, numbers = code[:, :PERMUTATIONS], np.ascontiguousarray(code[:, PERMUTATIONS:]).view(np.int64)
        cuts = [*np.flatnonzero((np.diff(band, prepend=-1) != 0) | (np.diff(h, prepend=h[0]) != 0)), len(ids)]
        out = []
        for x, y in zip(cuts, cuts[1:], strict=False):
            left = x + np.flatnonzero(block[x:y] == low)
            right = left if low == high else x + np.flatnonzero(block[x:y] == high)
            for at, i in enumerate(left):
                others = right[at + 1 :] if low == high else right
                others = others[~crowd[others]] if crowd[i] else others
                # a pair counts in the first band that it shares only
                others = others[(numbers[others] == numbers[i]).argmax(1) == band[x]]
                others = others[(places[others] == places[i]).mean(1) >= threshold - _SLACK]
                if len(others):
                    out.append(np.column_stack([np.full(len(others), ids[i]), ids[others]]))
        pairs = np.sort(np.concatenate(out), axis=1) if out else np.empty((0, 2), dtype=np.int64)
        return pd.DataFrame(pairs, columns=["a", "b"])

    return run


def candidates(signed: DataFrame, threshold: float = THRESHOLD, crowd: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of rows (id, sig, bands) that share a band and whose signatures nearly agree, each once.

    Bands of a block or less share tasks, many to one; of larger ones each pair of blocks is its own. Given a ``crowd``
    (id), the rows of larger bands, pairs within it are left out, and these bands with them.
    """
    held = _shared(_members(signed)).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    if crowd is None:
        held = held.withColumn("crowd", F.lit(False))
    else:
        held = held.where(F.col("n") <= BLOCK).join(crowd.withColumn("crowd", F.lit(True)), "id", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
    held = staged(held, "held")
    held = held.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    groups = max(1, -(-held.count() // GROUP_ROWS))
    group = F.when(F.col("blocks") > 1, F.xxhash64("band", "h")).otherwise(F.pmod(F.xxhash64("band", "h"), F.lit(groups)))
    dealt = held.withColumn("group", group).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "h", "group", "id", "block", "crowd", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    whole = dealt.join(signed.select("id", "sig"), "id")
    tasks = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return whole.repartition(tasks, "group", "low", "high").groupBy("group", "low", "high").applyInPandas(_alike(threshold), "a long, b long")


def _crowd(signed: DataFrame) -> DataFrame:
    """(id) of the rows that share a band with more than a block of others."""
    members = _members(signed)
    large = members.groupBy("band", "h").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).drop("n")
    return staged(members.join(large, ["band", "h"], "left_semi").select("id").distinct(), "crowd")


def _split(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The sets (``by_size``) of the crowd of ``sets`` (id, n, g), which are to be compared by size, and the similar pairs
    (a, b, jaccard) of other rows, with each other and with it.

    The candidates of a crowd grow with the square of its size, and most are not similar; nothing of them is stored.
    """
    signed = staged(_signatures(sets), "signatures")
    crowd = _crowd(signed)
    others = staged(reaching(candidates(signed, threshold, crowd), sets, threshold), "pairs")
    return by_size(sets.join(crowd, "id", "left_semi"), "crowd-sets"), others


def minhash_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b, jaccard) as ``near_pairs`` gives them, of rows of ``docs`` (id, text) that share a band, and all pairs of
    the rows of large bands. Pairs of one large family are all listed; ``minhash_keep`` doesn't need them."""
    crowd, others = _split(staged(_first_sets(docs), "sets"), threshold)
    return similar_pairs(crowd, threshold).union(others)


def _dropped(sets: DataFrame, threshold: float, rounds: int) -> DataFrame:
    """The ids of ``sets`` (id, n, g) that ``keep_first`` leaves out."""
    crowd, others = _split(sets, threshold)
    dropped = dropped_greedily(crowd, threshold, others.select("a", "b"), rounds)
    return sets.select("id").limit(0) if dropped is None else dropped


def keep_first(texts: DataFrame, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """The rows (id, t) of ``texts``, distinct ones, that are kept in order of id: all that are not similar to a kept one.

    A row without an earlier similar one is kept, and what is similar to it goes, so that a large family is reduced to its
    kept rows without a list of its pairs. After ``rounds`` such rounds, pairs of what is left decide.
    """
    return texts.join(_dropped(staged(gram_sets(texts, K), "sets"), threshold, rounds), "id", "left_anti")


def minhash_keep(docs: DataFrame, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """The ids of ``docs`` (id, text) that stay: in order of id, each distinct text that no kept one is similar to."""
    first = docs.groupBy(F.sha2(F.coalesce(normalize(F.col("text")), F.lit("\x00null")), 256)).agg(F.min("id").alias("id")).select("id")
    return first.join(_dropped(staged(_first_sets(docs), "sets"), threshold, rounds), "id", "left_anti")


class BandIndex:
    """Kept texts and their bands, stored between batches: a folder per batch, written anew if the batch is run again."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str, before: int | None) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            rows = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing is stored yet
            return self.spark.createDataFrame([], schema)
        return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")

    def texts(self, before: int | None = None) -> DataFrame:
        return self._read("texts", "id long, t string", before)

    def bands(self, before: int | None = None) -> DataFrame:
        return self._read("bands", "band int, h long, id long", before)

    def add(self, docs: DataFrame, batch: int, threshold: float = THRESHOLD) -> DataFrame:
        """Keep of ``docs`` (id, text) what is similar to no text kept by an earlier batch and, in order of id, by this
        one; the kept rows (id, t) are stored and returned. An equal text is similar, however short."""
        texts = staged(distinct_texts(docs), "texts")
        fresh = staged(_without(texts, self.texts(batch)), "fresh")
        mine = _members(signatures(fresh))
        met = mine.withColumnRenamed("id", "b").join(self.bands(batch).withColumnRenamed("id", "a"), ["band", "h"]).select("a", "b").distinct()
        known = self.texts(batch).join(met.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
        # both sides may use the same ids: what is known has even ones here
        sets = gram_sets(known, K).withColumn("id", F.col("id") * 2).union(gram_sets(fresh, K).withColumn("id", F.col("id") * 2 + 1))
        met = met.select((F.col("a") * 2).alias("a"), (F.col("b") * 2 + 1).alias("b"))
        similar = reaching(met, staged(sets, "sets"), threshold).select(F.when(F.col("a") % 2 == 0, F.col("b")).otherwise(F.col("a")).alias("id"))
        similar = similar.select(F.shiftright("id", 1).alias("id")).distinct()
        kept = staged(keep_first(staged(fresh.join(similar, "id", "left_anti"), "new"), threshold), "kept")
        for name, rows in (("texts", kept), ("bands", _members(signatures(kept)).select("band", "h", "id"))):
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        return kept


def _without(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose text is not in ``known``, by its hash."""
    digest = F.sha2(F.coalesce("t", F.lit("\x00null")), 256)
    return texts.withColumn("_h", digest).join(known.select(digest.alias("_h")), "_h", "left_anti").drop("_h")
