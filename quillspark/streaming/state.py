"""Stateful streams: incremental ingestion, caches that expire, rolling references, session histories, request ledgers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.functions.text import normalize
from quillspark.operators.minhash import BandIndex
from quillspark.sources.files import changed, write_manifest


def incremental_ingest(spark: SparkSession, root: str, manifest: str, ingest: Callable[[DataFrame], None], checkpoint: str):
    """Query that ingests files as they arrive; each batch leaves out what the manifest has and records it afterwards."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)
    files = files.withColumn("sha256", F.sha2("content", 256))

    def batch(rows: DataFrame, _: int) -> None:
        from pyspark.errors import AnalysisException

        try:
            known = spark.read.parquet(manifest)
        except AnalysisException:  # the first batch has no manifest yet
            known = spark.createDataFrame([], "path string, sha256 string")
        fresh = changed(rows, known)
        ingest(fresh)
        write_manifest(fresh, manifest)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exact_dedup(stream: DataFrame, ts: str, text: str, within: str = "1 hour") -> DataFrame:
    """The first row of each normalised text within the watermark."""
    marked = stream.withColumn("content_hash", F.sha2(normalize(F.col(text)), 256))
    return marked.withWatermark(ts, within).dropDuplicatesWithinWatermark(["content_hash"])


def ledger(stream: DataFrame, ts: str, window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Requests, total and mean value per window and stage, with a watermark for late rows."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))


def sessions(stream: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows of each user: start, end and number of events."""
    grouped = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), user)
    return grouped.agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class _Histories(StatefulProcessor):
    """The last messages of each session, as a list."""

    def __init__(self, most: int, ttl_ms: int | None) -> None:
        self.most, self.ttl_ms = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getListState("messages", "turn long, role string, text string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("turn", kind="stable")
        held = list(self.messages.get()) if self.messages.exists() else []
        held = (held + list(new[["turn", "role", "text"]].itertuples(index=False, name=None)))[-self.most :]
        self.messages.put(held)
        yield pd.DataFrame({"session_id": [key[0]], "messages": [[{"turn": t, "role": r, "text": x} for t, r, x in held]]})


def capped_history(stream: DataFrame, most: int = 40, ttl: str | None = None) -> DataFrame:
    """(session_id, messages) after each batch of ``stream`` (session_id, turn, role, text): the last ``most`` messages of
    the sessions that it touches, as they arrived and by turn within a batch. A session's messages go once ``ttl`` has
    passed since they were written, if there is one."""
    _stored_in_rocksdb(stream.sparkSession)
    return stream.select("session_id", F.col("turn").cast("long").alias("turn"), "role", "text").groupBy("session_id").transformWithStateInPandas(
        _Histories(most, None if ttl is None else 1000 * _seconds(ttl)),
        f"session_id {stream.schema['session_id'].dataType.simpleString()}, messages array<struct<turn:long,role:string,text:string>>",
        "Update", "none" if ttl is None else "processingTime",
    )


class _Drift(StatefulProcessor):
    """The last vectors of each namespace and how many there have been."""

    def __init__(self, every: int, width: int, recent: int, dims: int, threshold: float) -> None:
        self.every, self.width, self.recent, self.dims, self.threshold = every, width, recent, dims, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.vectors = handle.getListState("vectors", "v array<double>")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("seq", kind="stable")
        seen = self.count.get()[0] if self.count.exists() else 0
        held = [np.asarray(v, dtype=np.float64) for (v,) in self.vectors.get()] if self.vectors.exists() else []
        out = []
        for v in new["vector"]:
            held.append(np.asarray(v[: self.dims], dtype=np.float64))
            seen += 1
            if seen % self.every == 0:
                a, b = np.mean(held[-self.width :], axis=0), np.mean(held[-self.recent :], axis=0)
                norms = float(np.linalg.norm(a) * np.linalg.norm(b))
                gap = float(np.sqrt(max(2 - 2 * float(a @ b) / norms, 0.0))) if norms else 0.0
                out.append((key[0], seen, gap, gap > self.threshold))
        self.vectors.put([(v.tolist(),) for v in held[-self.width :]])
        self.count.update((seen,))
        yield pd.DataFrame(out, columns=["namespace", "seen", "distance", "drifted"])


def rolling_drift(stream: DataFrame, every: int = 100, width: int = 1000, recent: int = 20, dims: int = 32, threshold: float = 0.15) -> DataFrame:
    """The checks of ``evaluation.rolling_drift`` as vectors (namespace, seq, vector) arrive: (namespace, seen, distance,
    drifted). Rows count in order of ``seq`` within a batch, and batches one after another."""
    _stored_in_rocksdb(stream.sparkSession)
    return stream.select("namespace", "seq", "vector").groupBy("namespace").transformWithStateInPandas(
        _Drift(every, width, recent, dims, threshold), "namespace string, seen long, distance double, drifted boolean", "Update", "none"
    )


class _Cache(StatefulProcessor):
    """Entries of a namespace with the time they were made; a timer for each takes it out."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "at long, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("at_ms", kind="stable")
        out = []
        for name, at, ts, value in new[["key", "at_ms", "ts", "value"]].itertuples(index=False, name=None):
            held = self.entries.getValue((name,)) if self.entries.containsKey((name,)) else None
            hit = held is not None and at - held[0] < self.ttl_ms
            if not hit:
                self.entries.updateValue((name,), (int(at), value))
                self.handle.registerTimer(int(at) + self.ttl_ms)
            out.append((key[0], name, ts, hit, held[1] if hit else value))
        yield pd.DataFrame(out, columns=["namespace", "key", "ts", "hit", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        for name in [k for k, v in self.entries.iterator() if v[0] + self.ttl_ms <= due]:
            self.entries.removeKey(name)
        return iter(())


def expiring_cache(stream: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """(namespace, key, ts, hit, value) of requests ``stream`` (namespace, key, ts, value): whether the namespace holds an
    entry of that key younger than ``ttl``, and its value; else the request's own becomes the entry. Entries are taken out
    by timers once the watermark has passed their time; requests later than ``ttl`` are dropped. Without a namespace each
    key is its own."""
    _stored_in_rocksdb(stream.sparkSession)
    # milliseconds as the watermark counts them, whatever the session's time zone
    stream = stream if "namespace" in stream.columns else stream.withColumn("namespace", F.col("key"))
    timed = stream.withWatermark("ts", ttl).withColumn("at_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return timed.select("namespace", "key", "ts", "value", "at_ms").groupBy("namespace").transformWithStateInPandas(
        _Cache(1000 * _seconds(ttl)), "namespace string, key string, ts timestamp, hit boolean, value string", "Append", "eventTime"
    )


def _seconds(duration: str) -> int:
    number, unit = duration.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")]


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _stored_in_rocksdb(spark: SparkSession) -> None:
    """State with lists, maps and timers needs the store that Spark keeps in RocksDB."""
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def near_dup_batches(stream: DataFrame, index: BandIndex, checkpoint: str, kept: Callable[[DataFrame], None] | None = None):
    """Query that keeps of each batch of ``stream`` (id, text) what is similar to nothing kept before it, and, in order of
    id, within it; ``kept`` gets the rows (id, t). The index holds the kept rows; a batch that is run again replaces its
    own."""

    def batch(rows: DataFrame, number: int) -> None:
        new = index.add(rows, number)
        if kept is not None:
            kept(new)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sampled_checks(stream: DataFrame, key: str, check: Callable[[DataFrame], None], checkpoint: str, rate: float = 0.05):
    """Query that runs ``check`` on a deterministic sample of each batch."""
    from quillspark.functions.predicates import sampled

    return stream.where(sampled(F.col(key), rate)).writeStream.foreachBatch(lambda rows, _: check(rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
