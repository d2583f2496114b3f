import datetime
import random
import shutil

from pyspark.sql import functions as F

from quillspark.operators import evaluation, minhash
from quillspark.operators.minhash import BandIndex
from quillspark.streaming import state


def run(query_df, name, mode):
    q = query_df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return query_df.sparkSession.table(name)


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_ledger_equals_the_batch(spark, tmp_path):
    rows = [(i, "a" if i % 2 else "b", float(i)) for i in range(100)]
    batch = spark.createDataFrame(rows, "i long, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.col("i") * 60))
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = state.ledger(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), "ts")
    got = run(live, "ledger", "complete")
    assert got.agg(F.sum("n"), F.sum("total")).first()[:] == (100, float(sum(range(100))))
    assert got.count() == 4


def add(tmp_path, frame, n):
    """File ``n`` of the source folder of a stream."""
    frame.coalesce(1).write.parquet(str(tmp_path / "staged" / str(n)))
    (tmp_path / "in").mkdir(exist_ok=True)
    part = next((tmp_path / "staged" / str(n)).glob("part-*.parquet"))
    shutil.copy(part, tmp_path / "in" / f"{n}.parquet")


def restarted(spark, tmp_path, make, schema, mode="append"):
    """A run of the query over what has arrived since its last run, from its checkpoint; the rows of this run."""
    out = []
    live = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = live.writeStream.outputMode(mode).foreachBatch(lambda rows, _: out.extend(rows.collect())).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return out


def test_history_holds_messages_across_restarts(spark, tmp_path):
    schema = "session_id long, turn int, role string, text string"
    say = lambda s, t: (s, t, "user" if t % 2 == 0 else "assistant", f"message {t} of {s}")
    make = lambda stream: state.capped_history(stream, 40)
    add(tmp_path, spark.createDataFrame([say(1, t) for t in range(29, -1, -1)] + [say(2, 0), (3, 0, None, None)], schema), 0)
    first = {r["session_id"]: [tuple(m) for m in r["messages"]] for r in restarted(spark, tmp_path, make, schema, "update")}
    assert first == {1: [say(1, t)[1:] for t in range(30)], 2: [say(2, 0)[1:]], 3: [(0, None, None)]}
    add(tmp_path, spark.createDataFrame([say(1, t) for t in range(30, 55)] + [say(4, 1)], schema), 1)
    second = {r["session_id"]: [tuple(m) for m in r["messages"]] for r in restarted(spark, tmp_path, make, schema, "update")}
    assert second == {1: [say(1, t)[1:] for t in range(15, 55)], 4: [say(4, 1)[1:]]}


def test_drift_equals_the_batch_form(spark, tmp_path):
    rng = random.Random(4)
    rows = [(n, i, [rng.random() + (i > 60) * (n == "b"), rng.random(), rng.random()]) for n in "ab" for i in range(103)]
    schema = "namespace string, seq long, vector array<double>"
    kinds = {"every": 10, "width": 40, "recent": 7, "dims": 2, "threshold": 0.2}
    got = []
    for n, (low, high) in enumerate(((0, 35), (35, 36), (36, 103))):
        add(tmp_path, spark.createDataFrame([r for r in rows if low <= r[1] < high], schema), n)
        got += restarted(spark, tmp_path, lambda stream: state.rolling_drift(stream, **kinds), schema, "update")
    want = evaluation.rolling_drift(spark.createDataFrame(rows, schema), **kinds).collect()
    key = lambda r: (r["namespace"], r["seen"], round(r["distance"], 9), r["drifted"])
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(want) == 20 and any(r["drifted"] for r in want)


def test_cache_expires_across_a_restart(spark, tmp_path):
    schema = "namespace string, key string, ts timestamp, value string"
    at = lambda minutes: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)
    make = lambda stream: state.expiring_cache(stream, "1 hour")
    found = lambda rows: sorted((r["namespace"], r["key"], (r["ts"] - at(0)).seconds // 60 + 1440 * (r["ts"] - at(0)).days, r["hit"], r["value"]) for r in rows)
    add(tmp_path, spark.createDataFrame([("n", "q", at(0), "v0"), ("n", "q", at(10), "v10"), ("m", "q", at(11), "w"), ("n", "r", at(50), "r50")], schema), 0)
    assert found(restarted(spark, tmp_path, make, schema)) == [("m", "q", 11, False, "w"), ("n", "q", 0, False, "v0"), ("n", "q", 10, True, "v0"), ("n", "r", 50, False, "r50")]
    add(tmp_path, spark.createDataFrame([("n", "q", at(59), "v59"), ("n", "q", at(60), "v60"), ("n", "r", at(109), "r109")], schema), 1)
    assert found(restarted(spark, tmp_path, make, schema)) == [("n", "q", 59, True, "v0"), ("n", "q", 60, False, "v60"), ("n", "r", 109, True, "r50")]
    # far later: the watermark has passed all entries
    add(tmp_path, spark.createDataFrame([("n", "q", at(500), "v500")], schema), 2)
    restarted(spark, tmp_path, make, schema)
    add(tmp_path, spark.createDataFrame([("n", "q", at(501), "v501"), ("n", "r", at(502), "r502")], schema), 3)
    assert found(restarted(spark, tmp_path, make, schema)) == [("n", "q", 501, True, "v500"), ("n", "r", 502, False, "r502")]


def test_near_duplicates_of_a_stream(spark, tmp_path):
    base = [" ".join(f"w{(7 * i + j) % 97}" for j in range(60)) for i in range(0, 97, 16)]
    texts = base[:3] + [base[0] + " x", base[1].upper()] + base[3:] + [base[5] + " y", base[5] + " z", "ab", "AB"]
    schema = "id long, text string"
    index = BandIndex(spark, f"file://{tmp_path}/bands")
    kept = []
    for n, (low, high) in enumerate(((0, 4), (4, 9), (9, len(texts)))):
        add(tmp_path, spark.createDataFrame(list(enumerate(texts))[low:high], schema), n)
        live = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        state.near_dup_batches(live, index, str(tmp_path / "checkpoint"), lambda rows: kept.extend(r["id"] for r in rows.collect())).awaitTermination(180)
    whole = minhash.minhash_keep(spark.createDataFrame(list(enumerate(texts)), schema))
    assert sorted(kept) == sorted(r["id"] for r in whole.collect()) and 3 not in kept and 4 not in kept and len(kept) < len(texts) - 3


def test_exact_dedup(spark, tmp_path):
    rows = spark.createDataFrame([(0, "A b"), (1, "a  B "), (2, "c")], "i long, text string").withColumn("ts", F.timestamp_seconds("i"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = state.exact_dedup(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "text")
    assert run(live, "unique", "append").count() == 2
