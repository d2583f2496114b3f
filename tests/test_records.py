import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chunk, context, dedup, evaluation, graph, search
from quillspark.plans import replies
from quillspark.sources import files, records
from quillspark.streaming import state


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_golden_sets(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"query": "a", "relevant_chunk_ids": ["1", "2"], "metadata": {"topic": "t"}}, {"query": "b", "namespace": "n"}]))
    got = {r["query"]: r for r in records.golden(spark, str(tmp_path / "g.json")).collect()}
    assert got["a"]["namespace"] == "default" and got["a"]["relevant_chunk_ids"] == ["1", "2"] and got["a"]["expected_answer_keywords"] == []
    assert got["b"]["namespace"] == "n" and got["b"]["relevant_chunk_ids"] == []


def test_ledger_files_and_routes(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for kind, n in (("cost", 1), ("latency", 2), ("cost", 3)):
        records.append_ledger(spark.createDataFrame([(n,)], "n long"), path, kind)
    assert rows_of(records.ledger(spark, path, "cost")) == [(1, "cost"), (3, "cost")]
    rows = spark.createDataFrame([("q1", "like"), ("q2", "unknown")], "question string, rating string")
    records.route_feedback(rows, str(tmp_path / "routed"))
    assert {p.name for p in (tmp_path / "routed").iterdir() if p.is_dir()} == {"rating=like", "rating=unknown"}
    records.write_jsonl(rows, str(tmp_path / "train"))
    assert rows_of(records.training_set(spark, str(tmp_path / "train"), "question string, rating string")) == [("q1", "like"), ("q2", "unknown")]
    records.write_jsonl(rows.limit(0), str(tmp_path / "none"))
    with pytest.raises(ValueError):
        records.training_set(spark, str(tmp_path / "none"), "question string")
    answers = spark.createDataFrame([("a", "I cannot answer", None), ("b", "It is so.", 0.9), ("c", "It is.", 0.1)], "query string, answer string, faithfulness double")
    records.route_unanswered(answers, str(tmp_path / "open"))
    assert {r["query"] for r in spark.read.json(str(tmp_path / "open")).collect()} == {"a", "c"}
    records.write_preferences(spark.createDataFrame([("team/a b", "short")], "namespace string, preference string"), str(tmp_path / "prefs"))
    assert (tmp_path / "prefs" / "slug=team_a_b").is_dir()


def test_index_by_namespace(spark, tmp_path):
    chunks = spark.createDataFrame([("n1", "paragraph", 1, "One two two"), ("n2", "paragraph", 2, "two"), ("n1", "section", 3, "one")], "namespace string, level string, chunk_id long, text string")
    records.write_index(chunks, str(tmp_path / "index"))
    back = spark.read.parquet(str(tmp_path / "index")).where("namespace = 'n1'")
    assert rows_of(back.select("term", "chunk_id", "dl", "tf")) == [("one", 1, 3, 1), ("two", 1, 3, 2)]


def test_cache_rows_expire(spark):
    row = records.cache_rows(spark.range(1), F.to_timestamp(F.lit("2024-01-01 00:00:00")), 90).first()
    assert (row["expires_at"] - row["cached_at"]).total_seconds() == 90


def test_docx(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda text, props="": f"<w:p>{props}<w:r><w:t>{text}</w:t></w:r></w:p>"
    style = lambda name: f'<w:pPr><w:pStyle w:val="{name}"/></w:pPr>'
    table = f"<w:tbl><w:tr><w:tc>{para('a')}</w:tc><w:tc>{para('b')}</w:tc></w:tr></w:tbl>"
    xml = f"<w:document {w}><w:body>{para('Top', style('Heading2'))}{para('Plain')}{para('item', '<w:pPr><w:numPr/></w:pPr>')}{table}{para(' ')}</w:body></w:document>"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", xml)
    df = spark.createDataFrame([("a.docx", held.getvalue()), ("b.docx", b"no zip"), ("c.docx", None)], "path string, content binary")
    assert rows_of(files.docx_elements(df)) == [("a.docx", 0, "Title", 2, "Top"), ("a.docx", 1, "NarrativeText", None, "Plain"), ("a.docx", 2, "ListItem", None, "item"), ("a.docx", 3, "Table", None, "| a | b |")]


def test_modularity_and_communities_equal_brute_force(spark):
    pairs = [(a, b, 1.0) for g in (range(5), range(5, 10), range(10, 14)) for a in g for b in g if a < b] + [(0, 5, 0.5), (9, 10, 0.5)]
    edges = spark.createDataFrame(pairs, "a long, b long, weight double")
    nodes = spark.range(14).withColumnRenamed("id", "node")
    found = graph.communities(nodes, edges)
    label = {r["node"]: r["community"] for r in found.collect()}

    def plain(label):
        m = sum(w for *_, w in pairs)
        degree = {n: sum(w for a, b, w in pairs if n in (a, b)) for n in range(14)}
        return sum(w for a, b, w in pairs if label[a] == label[b]) / m - sum(degree[i] * degree[j] for i in label for j in label if label[i] == label[j]) / (2 * m) ** 2

    assert abs(graph.modularity(found, edges) - plain(label)) < 1e-9
    planted = {n: 0 if n < 5 else 1 if n < 10 else 2 for n in range(14)}
    assert plain(label) >= plain(planted) - 1e-9
    assert graph.modularity(found, edges.limit(0)) == 0.0


def test_communities_are_connected(spark):
    # one label over two cliques that only a third community joins, as moves of single nodes can leave it
    clique = lambda nodes: [(a, b, 1.0) for a in nodes for b in nodes if a < b]
    pairs = clique(range(4)) + clique(range(4, 8)) + clique(range(8, 12)) + [(3, 8, 1.0), (7, 9, 1.0)]
    edges = spark.createDataFrame(pairs, "a long, b long, weight double")
    labels = spark.createDataFrame([(n, 0 if n < 8 else 1) for n in range(12)], "node long, community long")
    parts = {r["node"]: r["community"] for r in graph.connected_parts(labels, edges).collect()}
    assert parts == {n: n // 4 * 4 for n in range(12)}
    assert graph.modularity(graph.connected_parts(labels, edges), edges) > graph.modularity(labels, edges)


def test_levels_of_communities_beat_single_moves(spark):
    # a ring of small cliques: moves of single nodes stop at the cliques or below, contraction joins them further
    rng = random.Random(5)
    pairs = {}
    for c in range(12):
        for a in range(3):
            for b in range(a + 1, 3):
                pairs[3 * c + a, 3 * c + b] = 1.0
        x, y = sorted((3 * c, (3 * c + 3) % 36))
        pairs[x, y] = 1.0
    for _ in range(6):
        a, b = sorted(rng.sample(range(36), 2))
        pairs.setdefault((a, b), 0.5)
    edges = spark.createDataFrame([(*k, w) for k, w in pairs.items()], "a long, b long, weight double")
    nodes = spark.range(36).withColumnRenamed("id", "node")
    one, all_ = graph.local_moves(nodes, edges), graph.communities(nodes, edges)
    assert graph.modularity(all_, edges) >= graph.modularity(one, edges) - 1e-9
    label = {r["node"]: r["community"] for r in all_.collect()}
    assert len(label) == 36 and len(set(label.values())) < 13
    for community in set(label.values()):
        own = {n for n in label if label[n] == community}
        seen, front = {min(own)}, [min(own)]
        while front:
            n = front.pop()
            front += [m for a, b in pairs for m in ((b,) if a == n else (a,) if b == n else ()) if m in own and m not in seen and not seen.add(m)]
        assert seen == own


def test_coverage_of_names_within_words(spark, monkeypatch):
    monkeypatch.setattr(graph, "NAMES_A_PASS", 2)
    chunks = spark.createDataFrame([(1, "New York and Concatenation"), (2, "a cat in NEW YORK"), (3, None)], "chunk_id long, text string")
    wanted = spark.createDataFrame([("New York",), ("Cat",), ("Dog",), ("Then",), (None,)], "name string")
    assert {r["name"]: (r["n_chunks"], r["covered"]) for r in graph.entity_coverage(chunks, wanted).collect()} == {"New York": (2, True), "Cat": (2, True), "Dog": (0, False), "Then": (0, False), None: (0, False)}


def test_lists_and_filters(spark):
    hits = spark.createDataFrame([(1, c, r) for r, c in enumerate("abcd", 1)], "query_id long, chunk_id string, rank int")
    order = lambda reply: [r["chunk_id"] for r in search.listed_order(hits, spark.createDataFrame([(1, reply)], "query_id long, reply string")).orderBy("rank").collect()]
    assert order("[3, 1, 3, 9]") == ["c", "a", "b", "d"] and order("none") == ["a", "b", "c", "d"] and order(None) == ["a", "b", "c", "d"]
    chunks = spark.createDataFrame([(1, "n", "paragraph", "en"), (2, "m", "paragraph", "en"), (3, "n", "section", "en"), (4, "n", "paragraph", "de")], "id long, namespace string, level string, lang string")
    ids = lambda *a, **k: sorted(r["id"] for r in search.filtered(chunks, *a, **k).collect())
    assert ids() == ids("default") == [1, 2, 4] and ids("n", lang="en") == [1] and ids(None, None) == [1, 2, 3, 4]


def test_context_parts(spark):
    answers = spark.createDataFrame([(1, "x [CITE:b] y [CITE: a] [CITE:b]")], "answer_id long, answer string")
    chunks = spark.createDataFrame([("a", "s", "text a")], "chunk_id string, source_name string, text string")
    assert sorted(map(tuple, context.citations(answers, chunks).collect()), key=lambda r: r[1]) == [(1, 1, "b", None, None), (1, 2, "a", "s", "text a")]
    first = spark.createDataFrame([(1, "a", "t", 1)], "query_id long, chunk_id string, text string, rank int")
    second = spark.createDataFrame([(1, "a", "t", 1), (1, None, "new", 2)], "query_id long, chunk_id string, text string, rank int")
    assert context.merge_distinct(first, second).count() == 2
    docs = spark.createDataFrame([(1, "aa", 5), (2, "bbb", 1), (3, "c", 9)], "id long, text string, seq long")
    classes = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "id long, class long")
    assert [dedup.survivors(docs, classes, rule).first()["id"] for rule in ("longest", "newest", "oldest")] == [2, 3, 2]


def test_percentiles_equal_sorting(spark):
    import random

    rng = random.Random(1)
    rows = [(g, float(rng.randrange(n))) for g, n in (("a", 5), ("b", 1000), ("c", 1)) for _ in range(200)] + [("d", None)]
    got = evaluation.percentiles(spark.createDataFrame(rows, "g string, v double"), "v", (50, 95, 99), "g")
    for r in got.collect():
        values = sorted(v for g, v in rows if g == r["g"])
        assert [r["p50"], r["p95"], r["p99"]] == [values[max(1, round(p / 100 * len(values))) - 1] for p in (50, 95, 99)] and r["n"] == 200
    assert got.count() == 3


def test_model_steps(spark):
    queries = spark.createDataFrame([(1, "What about Berlin in 2024"), (2, None)], "query_id long, text string")
    assert replies.widened(queries).where("query_id = 1").first()["expanded"].startswith("What about Berlin")
    assert rows_of(replies.named_entities(queries).select("label", "text")) == [("DATE", "2024"), ("NAME", "Berlin"), ("NAME", "What")]
    turns = spark.createDataFrame([(7, t, "user" if t % 2 else "assistant", f"line {t}") for t in range(1, 20)], "session_id long, turn long, role string, text string")
    asked = spark.createDataFrame([(7, "and now?"), (8, "line 1"), (7, "line 17")], "session_id long, text string")
    assert {(r["session_id"], r["standalone"]) for r in replies.condensed(asked, turns).collect()} == {(7, "and now?"), (8, "line 1"), (7, "line 17")}
    assert {r["text"]: r["history_answer"] for r in replies.answered_from_history(asked, turns).collect()} == {"and now?": None, "line 1": None, "line 17": "line 18"}
    folded = replies.summarised_history(turns)
    assert folded.count() == 7 and folded.where("role = 'summary'").first()["turn"] == -1
    chunks = spark.createDataFrame([(1, "Anna met Bob. They spoke."), (2, "nothing here")], "chunk_id long, text string")
    entities, edges = replies.extracted_graph(chunks)
    assert {r["name"] for r in entities.collect()} >= {"Anna", "Bob"} and (1, "Anna", "Bob", "NEXT", 1.0) in rows_of(edges)
    assert replies.extracted_graph(chunks, client=lambda p: ["no json"] * len(p))[0].isEmpty()
    assert rows_of(replies.synthetic_questions(chunks).select("chunk_id")) == [(1,), (1,), (2,)]
    assert all(0 <= r["coherence"] <= 1 for r in replies.coherence(chunks).collect())
    assert replies.coherence(chunks, client=lambda p: ["?"] * len(p)).first()["coherence"] == 0.5
    items = spark.createDataFrame([(1, 1, "in 1990"), (1, 2, "in 2001"), (2, 1, "in 1990")], "query_id long, rank int, text string")
    assert rows_of(replies.conflicts(items)) == [(1, True), (2, False)]
    answers = spark.createDataFrame([(1, "q", "Berlin is large. Mars is green.", ["Berlin is a large city"]), (2, "q", "", ["x"])], "answer_id long, question string, answer string, contexts array<string>")
    assert [r["faithfulness"] for r in replies.faithfulness(answers).orderBy("answer_id").collect()] == [0.5, 1.0]
    assert replies.faithfulness(answers, client=lambda p: ["oops"] * len(p)).first()["faithfulness"] == 0.5
    assert {r["consistency"] for r in replies.self_consistency(answers, client=lambda p: ["about 0.25"] * len(p)).collect()} == {0.25}
    assert {r["consistency"] for r in replies.self_consistency(answers, client=lambda p: ["none"] * len(p)).collect()} == {0.5}
    assert replies.judged(answers, ["clear", "short"]).count() == 4
    assert rows_of(replies.counterfactuals(queries.where("query_id = 1")).select("pos")) == [(0,), (1,)]
    docs = spark.createDataFrame([("der Hund und die Katze",), ("short",), ("1234567890 1234567890 12",)], "text string")
    assert [r["language"] for r in replies.detected_languages(docs).collect()] == ["de", None, None]
    images = replies.image_captions(spark.createDataFrame([("x/a.PNG",), ("x/b.txt",)], "path string"))
    assert rows_of(images.select("path", "text")) == [("x/a.PNG", "Image a.PNG")]
    said = spark.createDataFrame([(1, 1, "set", "a"), (1, 2, "none", None), (1, 3, "clear", None), (1, 4, "none", None)], "session_id long, turn long, action string, preference string")
    assert [r["in_force"] for r in replies.reconciled_preferences(said).orderBy("turn").collect()] == ["a", "a", None, None]


def test_more_streams(spark, tmp_path):
    from test_streaming import run

    events = spark.createDataFrame([(1, 0), (1, 60), (1, 7200), (2, 0)], "user_id long, s long").select("user_id", F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    live = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    assert sorted(r["n"] for r in run(state.sessions(live(), "ts", "user_id"), "sessions_seen", "complete").collect()) == [1, 1, 2]
    keyed = live().select(F.col("user_id").cast("string").alias("key"), "ts", F.lit("v").alias("value"))
    hits = run(state.expiring_cache(keyed, "1 hour"), "cache_seen", "append").collect()
    assert sorted((r["key"], r["hit"]) for r in hits) == [("1", False), ("1", False), ("1", True), ("2", False)]
    seen = []
    state.sampled_checks(live(), "user_id", lambda rows: seen.append(rows.count()), str(tmp_path / "cp1"), 1.0).awaitTermination(120)
    assert sum(seen) == 4
    (tmp_path / "docs").mkdir()
    taken = []
    ingest = lambda: state.incremental_ingest(spark, str(tmp_path / "docs"), str(tmp_path / "manifest"), lambda rows: taken.extend(r["path"].rsplit("/", 1)[-1] for r in rows.collect()), str(tmp_path / "cp2")).awaitTermination(120)
    (tmp_path / "docs" / "a.txt").write_text("a")
    ingest()
    (tmp_path / "docs" / "b.txt").write_text("b")
    ingest()
    assert taken == ["a.txt", "b.txt"]


def test_plain_columns_line_counts_and_settings(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], {"a": "b"}, "t")], "n long, l array<int>, m map<string,string>, s string").withColumn("d", F.to_date(F.lit("2024-02-03")))
    assert tuple(records.sanitised(df).first()) == (1, "[1,2]", '{"a":"b"}', "t", "2024-02-03")
    (tmp_path / "a.log").write_text("1\n2\n3\n")
    (tmp_path / "b.log").write_text("one")
    got = records.line_counts(spark, [str(tmp_path / "a.log"), str(tmp_path / "b.log")])
    assert {r["path"].rsplit("/", 1)[-1]: r["lines"] for r in got.collect()} == {"a.log": 3, "b.log": 1}
    assert records.setting({"a": {"b": 1}}, "a.b") == 1 and records.setting({"a": 1}, "a.b", 2) == 2


def test_other_tokenizer_and_reranker(spark):
    docs = spark.createDataFrame([(1, "abcdefg")], "doc_id long, text string")
    letters = lambda c: F.regexp_extract_all(c, F.lit("."), F.lit(0))
    got = chunk.fixed_windows(docs, size=4, overlap=1, least=1, tokenize=letters, between="")
    assert [(r["start"], r["text"]) for r in got.orderBy("start").collect()] == [(0, "abcd"), (3, "defg"), (6, "g")]
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id long, chunk_id string, rank int")
    scores = spark.createDataFrame([(1, "c", 0.9), (1, "b", 0.1)], "query_id long, chunk_id string, rerank_score double")
    assert [r["chunk_id"] for r in search.rescored(hits, scores).orderBy("rank").collect()] == ["c", "b", "a"]


def test_parsers_take_texts_in_bounded_batches(spark):
    from quillspark.sources import files

    held = "spark.sql.execution.arrow.maxBytesPerBatch"
    pages = spark.createDataFrame([(1, "<h1>A</h1><p>b</p>")], "doc_id long, html string")
    chunks, wanted = spark.createDataFrame([(1, "New Cat")], "chunk_id long, text string"), spark.createDataFrame([("Cat",)], "name string")
    for run in (lambda: files.html_elements(pages), lambda: graph.entity_coverage(chunks, wanted)):
        spark.conf.unset(held)
        assert run().count() > 0 and int(spark.conf.get(held)) <= 8 << 20
