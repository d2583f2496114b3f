import random

from pyspark.sql import functions as F

from quillspark import queries, queries_more  # noqa: F401
from quillspark.functions.text import token_count
from quillspark.operators import chunk, context, datasets, dedup, evaluation, graph, search
from quillspark.plans import models, retrieval
from quillspark.sources import files, records


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_heading_stack_equals_a_stack(spark):
    rng = random.Random(3)
    data, expected = [], []
    for doc in range(30):
        stack = []
        for pos in range(20):
            title = rng.random() < 0.5
            depth = rng.randint(1, 4)
            expected.append((doc, pos, " > ".join(t for _, t in stack) or None))
            data.append((doc, pos, "Title" if title else "Text", depth if title else None, f"t{doc}-{pos}"))
            if title:
                while stack and stack[-1][0] >= depth:
                    stack.pop()
                stack.append((depth, f"t{doc}-{pos}"))
    out = chunk.heading_stack(spark.createDataFrame(data, files.ELEMENT))
    assert rows(out.select("doc_id", "pos", "breadcrumb"), "doc_id", "pos") == expected


def test_fixed_windows(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(100)))), (2, ""), (3, None)], "doc_id long, text string")
    out = rows(chunk.fixed_windows(docs, 40, 10, 5).select("doc_id", "start", "n_tokens"), "start")
    assert out == [(1, 0, 40), (1, 30, 40), (1, 60, 40), (1, 90, 10)]


def merged(parts, least):
    done, carry = [], ""
    for p in parts:
        carry = f"{carry} {p}" if carry else p
        if len(carry.split()) >= least:
            done.append(carry)
            carry = ""
    if carry:
        done = [*done[:-1], f"{done[-1]} {carry}"] if done else [carry]
    return done


def test_merge_small_equals_a_loop(spark):
    rng = random.Random(5)
    data = [(i, [" ".join(["w"] * rng.randint(1, 6)) for _ in range(rng.randint(0, 8))]) for i in range(200)]
    out = spark.createDataFrame(data, "i int, p array<string>").select("i", chunk.merge_small(F.col("p"), 7).alias("m")).collect()
    assert {r["i"]: r["m"] for r in out} == {i: merged(p, 7) for i, p in data}


def test_split_large(spark):
    t = "Aa bb cc. Dd ee. Ff gg hh ii. Jj."
    df = spark.createDataFrame([(t,)], "t string").select(chunk.split_large(F.col("t"), 5).alias("p"))
    assert df.first()["p"] == ["Aa bb cc. Dd ee.", "Ff gg hh ii. Jj."]
    assert df.select(token_count(F.col("p")[0])).first()[0] == 5


def test_segments(spark):
    data = [(1, i, t, s) for i, (t, s) in enumerate(zip("ABCDE", [0.9, 0.9, 0.1, 0.9, None], strict=True))]
    out = chunk.segments(spark.createDataFrame(data, "doc_id int, pos int, text string, similarity double"), 0.5)
    assert rows(out.select("segment", "text"), "segment") == [(0, "A B C"), (1, "D E")]


def test_rrf_ties_keep_the_first_list(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, chunk_id long, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], "query_id long, chunk_id long, rank int")
    assert [r[1] for r in rows(search.fuse([a, b], 3), "rank")] == [11, 10, 12]


def test_reranked(spark):
    hits = spark.createDataFrame([(1, c, i + 1, [3, 9, 1]) for i, c in enumerate((10, 11, 12, 13))], "query_id int, chunk_id int, rank int, order array<int>")
    assert [r[1] for r in rows(search.reranked(hits).select("query_id", "chunk_id", "rank"), "rank")] == [12, 10, 11, 13]


def test_fuzzy_terms(spark):
    asked = spark.createDataFrame([(1, "kitten"), (1, "ab")], "query_id int, term string")
    known = spark.createDataFrame([("kitten", 1), ("kittens", 1), ("kiten", 5), ("mitten", 9), ("ac", 1)], "term string, df long")
    assert {r["term"] for r in search.fuzzy_terms(asked, known).collect()} == {"kitten", "kittens", "kiten"}


def test_parent_expansion_replaces_first_hits_only(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "z", 4)], "query_id int, chunk_id string, rank int")
    nodes = spark.createDataFrame([("a", "S"), ("b", "S"), ("c", "T")], "node_id string, parent_id string")
    out = rows(context.expand_parents(hits, nodes).select("rank", "chunk_id"), "rank")
    assert out == [(1, "S"), (2, "b"), (3, "T"), (4, "z")]


def test_budget_stops_at_the_first_overflow(spark):
    items = spark.createDataFrame([(1, 1, "a", "x" * 40), (1, 2, "b", "y" * 400), (1, 3, "c", "z" * 4)], "query_id int, rank int, chunk_id string, text string")
    assert [r[0] for r in rows(context.within_budget(items, 20).select("rank"), "rank")] == [1]
    kept = context.compressed_budget(items, 200).first()["items"]
    assert [k["chunk_id"] for k in kept] == ["a", "b", "c"]


def test_consolidation(spark):
    schema = "source_file string, pos int, section string, breadcrumb string, category string, depth int, text string, page_number int, modality string, language string"
    data = [
        ("f", 0, None, None, "Title", 2, "Head", 1, "text", "en"), ("f", 1, "Head", "Head", "NarrativeText", None, "Body", 1, "text", "de"),
        ("f", 2, "Head", "Head", "ListItem", None, "Item", 3, "text", "en"), ("f", 3, "Head", "Head", "NarrativeText", None, "More", 2, "text", ""),
    ]
    out = {r["section_key"]: r for r in dedup.consolidated(spark.createDataFrame(data, schema)).collect()}
    assert out[""]["text"] == "## Head"
    assert out["Head"]["text"] == "Body\n\n- Item\n\nMore"
    assert (out["Head"]["page_start"], out["Head"]["page_end"], out["Head"]["language"]) == (1, 3, "de")


def test_near_duplicates(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank today"
    data = [(1, base), (2, base + "s"), (3, base.upper()), (4, "something else entirely, with other words"), (5, None), (6, "x")]
    docs = spark.createDataFrame(data, "id long, text string")
    pairs = dedup.near_pairs(docs)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(1, 2)}
    kept = dedup.keep_greedy(docs.select("id"), spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long"))
    assert sorted(r["id"] for r in kept.collect()) == [1, 3, 5, 6]


def test_near_pairs_and_keep_rules_equal_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(8):
        base = [rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(40)]
        for _ in range(5):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(40)] = rng.choice(["xx", "yyy", "z"])
            texts.append(" ".join(t))
    grams = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    first = {t: min(i for i, u in enumerate(texts) if u == t) for t in texts}
    ids = sorted(set(first.values()))
    expected = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in ids for b in ids if a < b}
    expected = {k: v for k, v in expected.items() if v >= 0.85}
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pairs = dedup.near_pairs(docs)
    got = {(r["a"], r["b"]): r["jaccard"] for r in pairs.collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - v) < 1e-12 for k, v in expected.items())
    one = docs.where(F.col("id").isin(ids))
    assert {r["id"] for r in dedup.keep_earlier(one, pairs).collect()} == set(ids) - {b for _, b in expected}
    kept = []
    for i in ids:
        if not any((k, i) in expected for k in kept):
            kept.append(i)
    assert sorted(r["id"] for r in dedup.keep_greedy(one, pairs).collect()) == kept


def test_near_dup_keep_keeps_short_texts(spark, tmp_path):
    base = "the quick brown fox jumps over the lazy dog near the river bank today"
    data = [(1, base), (2, base + "s"), (3, base.upper()), (4, "A."), (5, "  "), (6, None), (7, ""), (8, " a. "), (9, "b")]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("near_dup_keep", "near_dup_greedy"):
        assert rows(queries.QUERIES[name](spark, str(tmp_path)), "id") == [(1,), (4,), (5,), (6,), (9,)]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "R", 1.0), ("b", "c", "R", 2.0), ("c", "a", "S", 1.0), ("x", "y", "R", 1.0)], "source_id string, target_id string, relation_type string, weight double")
    starts = spark.createDataFrame([("a",)], "start string")
    assert rows(graph.neighbours(starts, edges, 2), "node") == [("a", "b", 1), ("a", "c", 2)]
    nodes = spark.createDataFrame([(n,) for n in "abcxyz"], "node string")
    found = graph.components(nodes, edges.selectExpr("source_id a", "target_id b"))
    assert rows(found, "node") == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("z", "z")]


def test_local_search_reads_the_first_chunks_of_a_frequent_name(spark):
    rng = random.Random(3)
    mentioned = sorted({(rng.randrange(400), f"n{min(int(rng.expovariate(0.4)), 20)}") for _ in range(1500)} | {(900 + i, f"n{30 + i}") for i in range(6)})
    links = [("n30", "n31"), ("n31", "n32"), ("n32", "n0"), ("n33", "n30"), ("n34", "n35"), ("n0", "n1")]
    asked = [(1, "Mno"), (2, "Abc"), (3, "Def Abc"), (4, "Ghi"), (5, "Jkl Ghi"), (6, "Nowhere")]
    names = {"n30": "mno", "n0": "abc", "n33": "def", "n34": "ghi", "n31": "jkl"}
    queries_ = spark.createDataFrame(asked, "query_id long, text string")
    entities = spark.createDataFrame(list(names.items()), "node_id string, name string")
    edges = spark.createDataFrame(links + links[:2], "source_id string, target_id string")
    rows_ = spark.createDataFrame([(c, n) for c, n in mentioned + mentioned[:50]], "chunk_id long, node_id string")
    for hops in (1, 2, 3):
        got, want = {}, {}
        out = graph.local_search(queries_, entities, edges, rows_, hops, 10)
        for r in out.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["depth"], r["chunk_id"]))
        for q, text_ in asked:
            depth = {n: 0 for n, name in names.items() if name in text_.lower().split()}
            for d in range(1, hops + 1):
                depth |= {b: d for a, b in links if depth.get(a) == d - 1 and b not in depth}
            best = {}
            for c, n in mentioned:
                if n in depth:
                    best[c] = min(best.get(c, 99), depth[n])
            if first := sorted((d, c) for c, d in best.items())[:10]:
                want[q] = first
        assert got == want


def test_communities_split_two_cliques(spark):
    pairs = [(a, b) for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1 :]] + [("d", "w")]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a string, b string, weight double")
    nodes = spark.createDataFrame([(n,) for n in "abcdwxyz"], "node string")
    found = {r["node"]: r["community"] for r in graph.communities(nodes, edges).collect()}
    assert len({found[n] for n in "abcd"}) == 1 and len({found[n] for n in "wxyz"}) == 1 and found["a"] != found["w"]


def test_retrieval_metrics(spark):
    results = spark.createDataFrame([(1, c, i + 1) for i, c in enumerate("abcde")], "query_id int, chunk_id string, rank int")
    qrels = spark.createDataFrame([(1, c) for c in "bdz"], "query_id int, chunk_id string")
    r = evaluation.retrieval_metrics(results, qrels, 3).first()
    assert (r["precision"], r["recall"], r["rr"]) == (1 / 3, 1 / 3, 0.5)
    assert evaluation.retrieval_metrics(results, qrels, 5).first()["recall"] == 2 / 3


def test_preferences_and_triplets(spark):
    data = [("q", "good", "like"), ("q", "bad", "dislike"), ("q", "bad", "dislike"), ("q", "I don't know", "like"), ("q", "good", "unknown"), ("p", "x", "like")]
    out = datasets.preference_pairs(spark.createDataFrame(data, "question string, answer string, rating string"))
    assert [tuple(r) for r in out.collect()] == [("q", "good", "bad")]
    positives = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "query_id int, chunk_id string")
    negatives = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, chunk_id string, rank int")
    assert rows(datasets.triplets(positives, negatives), "positive") == [(1, "a", "x"), (1, "b", "y"), (1, "c", "x")]
    own = datasets.random_negatives(spark.createDataFrame([(q, f"{q}-{i}") for q in range(20) for i in range(5)], "query_id int, chunk_id string"), 3)
    got = own.collect()
    assert len(got) == 60 and all(not r["chunk_id"].startswith(f"{r['query_id']}-") for r in got)


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><li>no</li></nav><h1>A &amp; B</h1><p>one<br>two</p><ul><li>x</li></ul><table><tr><th>h</th></tr><tr><td>1</td></tr></table><script>no()</script></body></html>"
    out = files.html_elements(spark.createDataFrame([(1, page), (2, None)], "doc_id long, html string"))
    assert rows(out.select("category", "depth", "text"), "pos") == [("Title", 1, "A & B"), ("Text", None, "one two"), ("ListItem", None, "x"), ("Table", None, "| h |\n| 1 |")]


def test_html_keeps_what_follows_unclosed_elements(spark):
    pages = {
        "<html><head><title>t</title><meta charset=x><body><p>one</p>": ["one"],
        "<head><title>t</title><script>no()</script><noscript><img src=x></noscript><link href=x><p>one</p>": ["one"],
        "<head><title>t</title><style>no</style> bare <p>one": ["bare", "one"],
        "<head><title>t</title><nav><li>no</li></nav><h1>A</h1>": ["A"],
        "<body><nav><li>home</li><p>one</p><nav>no</nav><p>two</p>": ["home", "one", "two"],
        "<head><noscript>no<body><p>one</p>": ["one"],
        "<p>one</p><table><tr><td>a<td>b<tr><td>c": ["one", "| a | b |\n| c |"],
        "<table><tr><td>a</td></tr><table><tr><td>b</td></tr></table><p>one</p>": ["| a |", "| b |", "one"],
        "<head><title>t</title></head><nav>no</nav></nav></head><p>one</p><script>no()": ["one"],
    }
    out = files.html_elements(spark.createDataFrame(list(enumerate(pages)), "doc_id long, html string")).orderBy("doc_id", "pos").collect()
    assert [[r["text"] for r in out if r["doc_id"] == i] for i in range(len(pages))] == list(pages.values())


def test_files_and_feedback(spark, tmp_path):
    for name in ("ns1/a.TXT", "ns1/sub/b.md", "ns2/c.html", "ns2/d.exe", ".hidden/e.txt"):
        p = tmp_path / "docs" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("hello")
    found = files.scan(spark, str(tmp_path / "docs"))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["a.TXT", "b.md", "c.html"]  # hidden folders are left out
    assert [r[0] for r in files.namespaces(found, str(tmp_path / "docs")).collect()] == ["ns1", "ns2"]
    files.write_manifest(found, str(tmp_path / "manifest"))
    assert files.changed(found, spark.read.parquet(str(tmp_path / "manifest"))).isEmpty()
    (tmp_path / "fb").mkdir()
    (tmp_path / "fb" / "x.jsonl").write_text('{"question": "q", "answer": "a"}\nbroken\n{"question": "", "answer": "a"}\n{"question": "q2", "answer": null}\n')
    (tmp_path / "fb" / "y.json").write_text('[{"question": "q3", "answer": "b", "rating": "like"}]')
    assert sorted((r["question"], r["rating"]) for r in records.feedback(spark, str(tmp_path / "fb")).collect()) == [("q", "unknown"), ("q3", "like")]


def test_plan_and_models(spark):
    docs = spark.createDataFrame([(i, f"Alpha beta {i}. Gamma delta word{i}. More text follows here.", "src") for i in range(6)], "doc_id long, text string, source string")
    chunks = retrieval.ingest(docs)
    asked = models.embedded(spark.createDataFrame([(1, "word3 gamma")], "query_id long, text string"), "text", "vector")
    out = retrieval.retrieve(asked, chunks).first()
    assert "word3" in out["prompt"].split("---")[0]
    reply = models.call(spark.createDataFrame([(out["prompt"],), (None,)], "p string"), "p", "r", "grounded").collect()
    assert "[CITE:" in reply[0]["r"] and reply[1]["r"] is None
