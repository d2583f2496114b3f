"""What must not grow with the tables: rows sent through the driver, rows of one task."""

from __future__ import annotations

from quillspark.operators import graph


def test_a_graph_does_not_pass_through_the_driver(spark, monkeypatch):
    plans, staged = [], graph.staged

    def seen(df, name="stage"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, name)

    monkeypatch.setattr(graph, "staged", seen)
    edges = spark.createDataFrame([(f"a{i}", f"n{i % 3}", 1.0) for i in range(9)], "a string, b string, weight double")
    labels = edges.selectExpr("a node", "b community").union(edges.selectExpr("b", "b")).distinct()
    found = graph.connected_parts(labels, edges)
    assert {r["community"] for r in found.collect()} == {"a0", "a1", "a2"}
    assert plans and not [p for p in plans if "BroadcastHashJoin" in p]


def test_postings_are_counted_without_a_shuffle_and_the_index_hashes_terms(spark, tmp_path):
    from quillspark import queries
    from quillspark.operators import bm25, search

    texts = ["A a b. B-a", "", None, " .. ", "Ünï ² x_y ªb İx Ⅷ 世界 a", "ǅ ß 3.5 naïve", "ȧ b­ c", "Ж ж 1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    split = docs.select("doc_id", bm25.terms(docs.text).alias("t")).collect()
    want = {(t, r["doc_id"], r["t"].count(t), len(r["t"])) for r in split for t in r["t"] or []}
    found = search.postings(docs.withColumnRenamed("doc_id", "chunk_id"))
    assert {tuple(r) for r in found.collect()} == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    out = queries.bm25_index(spark, str(tmp_path))
    assert {tuple(r)[:4] for r in out.collect()} == want
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_sentences_are_counted_once_when_packed(spark):
    from pyspark.sql import functions as F

    from quillspark.operators import chunk

    texts = ["One two. Three four five. Six. " + "Long " * 9 + "end. A b.", "", None, "x"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    found = docs.select(chunk.split_large(F.col("text"), 5).alias("p"))
    assert [r["p"] for r in found.collect()] == [["One two. Three four five.", "Six.", "Long " * 9 + "end.", "A b."], [], None, ["x"]]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\s+, -1") == 1, plan  # the split into words; packing split all that it held, once for each use
