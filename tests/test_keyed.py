import os

import pytest
from pyspark.sql import functions as F

from quillspark.sources.keyed import KeyedTable

SCHEMA = "k string, n int, seq long, v string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files_of(tmp_path, table):
    """Files by bucket, of the latest version."""
    found = {}
    for e in table.manifest():
        found[e["bucket"]] = sorted(str(p) for p in (tmp_path / "t" / "data" / e["folder"] / f"bucket={e['bucket']}").glob("part-*"))
    return found


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ("k", "n"), buckets=8)


def test_merge_rewrites_only_touched_buckets(spark, tmp_path, table):
    assert table.read().count() == 0 and table.versions() == []
    first = [(f"k{i}", i % 3, 1, "a") for i in range(60)] + [(None, None, 1, "null key")]
    assert table.merge(spark.createDataFrame(first, SCHEMA), F.col("seq")) == 0
    before = files_of(tmp_path, table)
    assert len(before) == 8 and all(len(v) == 1 for v in before.values())
    # an older row loses, an equal one and a newer one win, and of two new ones the later
    updates = [("k5", 2, 0, "old"), ("k6", 0, 1, "equal"), ("k7", 1, 2, "new"), ("k7", 1, 3, "newer"), (None, None, 2, "null again"), ("fresh", 0, 1, "fresh")]
    frame = spark.createDataFrame(updates, SCHEMA).withColumn("extra", F.lit(1))
    touched = {r[0] for r in frame.select(table._bucket()).collect()}
    assert table.merge(frame, F.col("seq")) == 1
    want = {(k, n): (k, n, s, v) for k, n, s, v in first} | {("k6", 0): updates[1], ("k7", 1): updates[3], (None, None): updates[4], ("fresh", 0): updates[5]}
    assert rows(table.read()) == sorted(want.values(), key=repr)
    after = files_of(tmp_path, table)
    assert touched < set(range(8)) and all(after[b] == before[b] for b in set(range(8)) - touched) and all(after[b] != before[b] for b in touched)
    assert rows(table.read(0)) == sorted(first, key=repr) and sum(e["rows"] for e in table.manifest()) == len(want)
    assert table.merge(frame.limit(0), F.col("seq")) == 1  # nothing to do, no new version


def test_a_failed_merge_leaves_the_table_as_it_was(spark, table):
    first = [(f"k{i}", 0, 1, "a") for i in range(20)]
    table.merge(spark.createDataFrame(first, SCHEMA), F.col("seq"))
    broken = spark.createDataFrame([("k1", 0, 2, "b")], SCHEMA).withColumn("v", F.raise_error(F.lit("broken row")).cast("string"))
    with pytest.raises(Exception, match="broken row"):
        table.merge(broken, F.col("seq"))
    assert rows(table.read()) == sorted(first) and table.versions() == [0]
    # the manifest of a writer that died stands unfinished and is passed over
    at = table.path.removeprefix("file://")
    os.makedirs(f"{at}/manifests/version=1")
    assert rows(table.read()) == sorted(first)
    assert table.merge(spark.createDataFrame([("k1", 0, 2, "b")], SCHEMA), F.col("seq")) == 2
    assert ("k1", 0, 2, "b") in rows(table.read())


def test_deletes_and_vacuum(spark, tmp_path, table):
    table.merge(spark.createDataFrame([("a", 0, 1, "x"), ("b", 0, 1, "y")], SCHEMA), F.col("seq"))
    table.merge(spark.createDataFrame([("a", 0, 2, "gone"), ("b", 0, 0, "gone")], SCHEMA), F.col("seq"), F.col("v") == "gone")
    assert rows(table.read()) == [("b", 0, 1, "y")]
    table.merge(spark.createDataFrame([("b", 0, 3, "gone")], SCHEMA), F.col("seq"), F.col("v") == "gone")
    assert table.read().count() == 0 and table.manifest() == []
    table.merge(spark.createDataFrame([("c", 0, 1, "z")], SCHEMA), F.col("seq"))
    assert len(table.vacuum()) >= 4 and table.versions() == [3] and rows(table.read()) == [("c", 0, 1, "z")]
