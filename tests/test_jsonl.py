import json

from quillspark.sources import jsonl
from quillspark.sources import records as plain


def line(**fields):
    return json.dumps(fields) + "\n"


def found(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


def write(tmp_path):
    folder = tmp_path / "in"
    (folder / "liked").mkdir(parents=True)
    (folder / "liked" / "a.jsonl").write_text(line(query_id="1", question="q", answer="a", rating="up") + "{broken\n\n" + line(query_id="2", question="  ", answer="a") + "[1]\n" + line(query_id=3, question="q3", answer="ä", extra=1))
    (folder / "b.json").write_text(json.dumps([{"query_id": "4", "question": "q4", "answer": None}, {"query_id": "5", "question": ["no", "text"]}]))
    (folder / "c.json").write_text("{")
    (folder / "notes.txt").write_text("not read")
    return folder


def test_broken_records_are_reported(spark, tmp_path):
    folder = write(tmp_path)
    rows = jsonl.checked_feedback(jsonl.records(spark, str(folder))).collect()
    got = [(r["query_id"], r["rating"], r["source_file"].rsplit("/", 1)[-1], (r["problem"] or "").split(":")[0]) for r in rows]
    assert sorted(got, key=repr) == sorted(
        [("1", "up", "a.jsonl", ""), (None, None, "a.jsonl", "no JSON"), ("2", "unknown", "a.jsonl", "no question"), (None, None, "a.jsonl", "not an object"), ("3", "unknown", "a.jsonl", ""),
         ("4", "unknown", "b.json", "no answer"), (None, None, "b.json", '["no", "text"] is no string'), (None, None, "c.json", "no JSON")], key=repr)
    good = [r for r in rows if r["problem"] is None]
    kept = plain.feedback(spark, str(folder)).collect()
    assert found(good, "query_id", "question", "answer", "rating") == found(kept, "query_id", "question", "answer", "rating")
    assert jsonl.records(spark, str(folder)).rdd.getNumPartitions() == 3


def test_golden_sets(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"query": "a", "relevant_chunk_ids": ["1"], "metadata": {"topic": "t"}}, {"query": "b", "relevant_chunk_ids": "1"}]))
    rows = jsonl.records(spark, f"file://{tmp_path}", jsonl.GOLDEN).collect()
    assert [(r["query"], r["relevant_chunk_ids"], r["metadata"], r["place"], r["problem"]) for r in rows] == [("a", ["1"], {"topic": "t"}, 0, None), (None, None, None, 1, '"1" is no array<string>')]


def test_the_stream_reads_what_the_batch_reads(spark, tmp_path):
    folder = write(tmp_path)
    with open(folder / "liked" / "a.jsonl", "a") as f:
        f.write("\n")
    out = []

    def run():
        q = jsonl.records(spark, str(folder), stream=True).writeStream.foreachBatch(lambda rows, _: out.append(rows.collect())).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    columns = ("query_id", "question", "source_file", "place", "problem")
    run()
    first = [r for rows in out for r in rows]
    assert found(first, *columns) == found(jsonl.records(spark, str(folder)).collect(), *columns)
    # a line that is not yet whole waits; after it is, the next run has it and nothing else
    with open(folder / "liked" / "a.jsonl", "a") as f:
        f.write('{"query_id": "6", "question"')
    (folder / "d.jsonl").write_text(line(query_id="7", question="q7", answer="a"))
    out.clear()
    run()
    assert [r["query_id"] for rows in out for r in rows] == ["7"]
    with open(folder / "liked" / "a.jsonl", "a") as f:
        f.write(': "q6"}\n')
    out.clear()
    run()
    assert [(r["query_id"], r["question"]) for rows in out for r in rows] == [("6", "q6")]
    assert jsonl.records(spark, str(tmp_path / "nothing")).count() == 0
