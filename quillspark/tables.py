"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder. Where neither is set, a temporary folder in local
    mode; on a cluster, whose executors could not read one, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def staged(df: DataFrame, name: str = "stage", *by: str) -> DataFrame:
    """``df`` as a table in the shared folder, in folders of the columns ``by``: cuts the lineage of an iteration, survives
    lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of the rows that go to a Python worker at once; a longer row goes alone.
BATCH_BYTES = 8 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches of texts in Python workers by bytes; a value of the cluster's configuration is kept."""
    if not spark.sparkContext.getConf().contains(_BATCHES):
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


@atexit.register
def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM may be gone already; the folder is scratch space either way
            return
