"""Keyed tables with copy-on-write merges: only buckets that updates touch are written anew, then a manifest names them.

    <path>/data/<write>/bucket=<n>/...     files of one write, never changed afterwards
    <path>/manifests/version=<v>/...       the folder of each bucket in version v, complete once Spark marks it so
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.records import upsert

_MANIFEST = "bucket int, folder string, rows long"


@dataclass(frozen=True)
class KeyedTable:
    """A table of ``schema`` (DDL) at ``path`` with one row for each value of ``keys``, which may be null."""

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = 64

    def _folders(self, parent: str) -> list[str]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{parent}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def _exists(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def versions(self) -> list[int]:
        """The versions that were written whole, ascending."""
        found = sorted(int(x.split("=")[1]) for x in self._folders("manifests") if x.startswith("version="))
        return [v for v in found if self._exists(f"manifests/version={v}/_SUCCESS")]

    def manifest(self, version: int | None = None) -> list:
        """(bucket, folder, rows) of a version, by default the latest: a row per bucket."""
        known = self.versions()
        if version is None and not known:
            return []
        return self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifests/version={known[-1] if version is None else version}").collect()

    def _read(self, entries: list) -> DataFrame:
        paths = [f"{self.path}/data/{e['folder']}/bucket={e['bucket']}" for e in entries]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the latest."""
        return self._read(self.manifest(version))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, updates: DataFrame, seq: Column, deleted: Column | None = None) -> int:
        """Merge ``updates`` by key and return the new version: of rows that share a key the latest by ``seq`` stays, an
        update over a stored row of equal seq; a key whose latest row is ``deleted`` goes.

        Untouched buckets keep their files. Nothing refers to the new files before the manifest is whole, so a merge that
        fails leaves the table as it was; of two merges at once, the second to end fails, as its version is taken.
        """
        known = self.versions()
        # a manifest that a failed writer left unfinished has its number too
        taken = [int(x.split("=")[1]) for x in self._folders("manifests") if x.startswith("version=")]
        version, entries = max(taken, default=-1) + 1, self.manifest()
        columns = self.spark.createDataFrame([], self.schema).columns
        updates = updates.withColumn("_gone", F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))).select(*columns, "_gone")
        touched = {r[0] for r in updates.select(self._bucket()).distinct().collect()}  # as many as there are buckets at most
        if not touched:
            return known[-1] if known else -1
        stored = self._read([e for e in entries if e["bucket"] in touched]).withColumn("_gone", F.lit(False))
        merged = upsert(stored, updates, list(self.keys), seq).where("not _gone").drop("_gone").withColumn("bucket", self._bucket())
        folder = uuid.uuid4().hex
        # a bucket is one file, however many tasks hold its rows
        merged.repartition(min(self.buckets, len(touched)), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        new = []
        if any(x.startswith("bucket=") for x in self._folders(f"data/{folder}")):
            new = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/data/{folder}").groupBy("bucket").count().collect()
        now = [tuple(e) for e in entries if e["bucket"] not in touched] + [(r["bucket"], folder, r["count"]) for r in new]
        self.spark.createDataFrame(now, _MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{self.path}/manifests/version={version}")
        return version

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the folders of data and the manifests that none of the last ``keep`` versions needs; their names."""
        known = self.versions()
        needed = {e["folder"] for v in known[-keep:] for e in self.manifest(v)}
        gone = [f"data/{x}" for x in self._folders("data") if x not in needed] + [f"manifests/version={v}" for v in known[:-keep]]
        for name in gone:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return gone
