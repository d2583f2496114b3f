"""Registered queries of the retrieval operators, each over its whole tables, with the SQL they equal.

Searches take the rows whose id is divisible by 100 as queries, or the benchmark's items. Rounded values are
rounded in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import metrics, predicates, text
from quillspark.operators import chunk, context, datasets, dedup, evaluation, graph, lookup, search
from quillspark.sources import files, records

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- SQL shared by several queries ----------------------------------------------------------------------------

_SEP = "chr(1)"
_ABBR = "Mr|Mrs|Ms|Dr|Prof|Sr|Jr|vs|etc|e\\.g|i\\.e"


def _sentences(t: str) -> str:
    held = f"regexp_replace({t}, '(?i)\\b({_ABBR})\\.', '\\1' || chr(2), 'g')"
    cut = f"regexp_replace({held}, '([.!?])\\s+([A-Z0-9\"''(\\[])', '\\1' || {_SEP} || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({cut}, {_SEP}), lambda x: regexp_replace(replace(x, chr(2), '.'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


def _terms(t: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '\\s+'), lambda x: x <> '')"


def _capitalised(t: str) -> str:
    runs = f"list_filter(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-zA-Z]{{2,}}'))"
    return runs


def _dense(k: int, name: str = "dense", where: str = "TRUE", own: str = "a.vec_id <> b.vec_id") -> str:
    """CTE of the k best chunks of each query vector."""
    return f"""{name} AS (
  SELECT * FROM (
    SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM (
      SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
      FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND {own} AND {where}))
  WHERE rank <= {k})"""


_POSTED = f"""posted AS (
  SELECT doc_id AS chunk_id, t.term, count(*) AS tf, any_value(len(l)) AS dl
  FROM (SELECT doc_id, {_terms("text")} AS l FROM documents), unnest(l) AS t(term) GROUP BY doc_id, t.term),
stats AS (SELECT count(*) AS n_docs, avg(len({_terms("coalesce(text, '')")})) AS avgdl FROM documents),
idf AS (SELECT term, ln(1 + (n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posted, stats GROUP BY term, n_docs)"""


def _bm25(k: int, asked: str, name: str = "sparse") -> str:
    """CTEs of the k best chunks of each query; ``asked`` selects (query_id, term)."""
    return f"""asked_{name} AS (SELECT DISTINCT query_id, term FROM ({asked})),
{name} AS (
  SELECT * FROM (
    SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM (
      SELECT query_id, chunk_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM asked_{name} JOIN idf USING (term) JOIN posted USING (term), stats GROUP BY query_id, chunk_id))
  WHERE rank <= {k})"""


def _fused(lists: list[str], k: int, name: str = "fused") -> str:
    union = " UNION ALL ".join(f"SELECT query_id, chunk_id, rank, {i} AS list_no FROM {one}" for i, one in enumerate(lists))
    return f"""{name} AS (
  SELECT query_id, chunk_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f // 100000, f % 100000, chunk_id)::INTEGER AS rank FROM (
      SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list_no * 100000 + rank) AS f FROM ({union}) GROUP BY ALL))
  WHERE rank <= {k})"""


# ---- search -----------------------------------------------------------------------------------------------------


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return docs.join(vectors, "chunk_id", "left")


def _asked(chunks: DataFrame) -> DataFrame:
    return chunks.where("chunk_id % 100 = 0 and vector is not null").selectExpr("chunk_id query_id", "text", "vector")


_HAS_DOC = "b.vec_id IN (SELECT doc_id FROM documents) AND a.vec_id IN (SELECT doc_id FROM documents)"
_DOC_QUERIES = f"SELECT doc_id AS query_id, unnest({_terms('text')}) AS term FROM documents WHERE doc_id % 100 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)"


@query(f"WITH {_dense(40, where=_HAS_DOC, own='TRUE')}, {_POSTED}, {_bm25(40, _DOC_QUERIES)}, {_fused(['dense', 'sparse'], 20)} SELECT * FROM fused")
def hybrid_rrf_topk(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    return search.hybrid(_asked(chunks), chunks, 20)


_LEGS = f"""SELECT doc_id * 1000 AS query_id, unnest({_terms('text')}) AS term FROM documents WHERE doc_id % 100 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)
 UNION ALL SELECT doc_id * 1000 + 1, unnest({_terms("string_split(text, chr(10))[-1]")}) FROM documents WHERE doc_id % 100 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)"""


@query(f"""WITH {_dense(40, name='dense0', where=_HAS_DOC, own='TRUE')}, dense AS (SELECT query_id * 1000 AS query_id, chunk_id, rank FROM dense0),
{_POSTED}, {_bm25(40, _LEGS)}, {_fused(['dense', 'sparse'], 20, 'inner_')},
back AS (SELECT query_id // 1000 AS query_id, chunk_id, rank, query_id % 1000 AS list_no FROM inner_),
scored AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list_no * 100000 + rank) AS f FROM back GROUP BY query_id, chunk_id)
SELECT query_id, chunk_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f // 100000, f % 100000, chunk_id)::INTEGER AS rank FROM scored) WHERE rank <= 20""")  # fmt: skip
def multi_query_rrf(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    asked = _asked(chunks)
    last = F.element_at(F.split("text", "\n"), -1)
    legs = asked.withColumn("leg", F.lit(0)).unionByName(asked.select("query_id", last.alias("text"), F.lit(None).cast("array<float>").alias("vector"), F.lit(1).alias("leg")))
    return search.multi_query(legs, chunks, 20)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def _dense_hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    v = _vectors(spark, d)
    return search.dense_topk(v.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id"), v, k, exclude_self=True)


@query(f"WITH {_dense(10)} SELECT * FROM dense")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense_hits(spark, d, 10)


_BENCH_QUERIES = f"SELECT item_id AS query_id, unnest({_terms('text')}) AS term FROM benchmark"


@query(f"WITH {_POSTED}, {_bm25(10, _BENCH_QUERIES)} SELECT query_id, chunk_id, score, rank FROM sparse")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25_topk(asked, read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), 10)


@query(f"WITH {_POSTED}, df AS (SELECT term, count(*) AS df FROM posted GROUP BY term) SELECT p.term, p.chunk_id, p.tf, p.dl::INTEGER AS dl, df.df FROM posted p JOIN df USING (term)")
def bm25_index(spark: SparkSession, d: str) -> DataFrame:
    posted = search.postings(read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))
    # the terms are hashed and the postings pass by: sorted ones would fill a task as the table grows
    counted = posted.groupBy("term").agg(F.count("*").alias("df"))
    return posted.join(counted.hint("shuffle_hash"), "term").select("term", "chunk_id", "tf", "dl", "df")


@query(f"""WITH {_dense(20)}, parents AS (SELECT vec_id AS chunk_id, label + 1000000 AS parent_id FROM embeddings),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) AS n FROM dense JOIN parents USING (chunk_id))
SELECT query_id, CASE WHEN n = 1 THEN parent_id ELSE chunk_id END AS chunk_id, rank, score, n = 1 AS expanded FROM numbered""")
def parent_expand(spark: SparkSession, d: str) -> DataFrame:
    nodes = _vectors(spark, d).select(F.col("chunk_id").alias("node_id"), (F.col("label") + 1_000_000).cast("long").alias("parent_id"))
    return context.expand_parents(_dense_hits(spark, d, 20), nodes)


@query(f"WITH {_dense(10)} SELECT query_id, chunk_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank = 2 THEN 11 ELSE rank END)::INTEGER AS position FROM dense")
def position_order(spark: SparkSession, d: str) -> DataFrame:
    return context.position_order(_dense_hits(spark, d, 10)).select("query_id", "chunk_id", "rank", "position")


@query(f"""WITH {_dense(40)}, sized AS (
  SELECT query_id, chunk_id, rank, sum(length(text) // 4) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS running_tokens FROM dense JOIN documents ON chunk_id = doc_id)
SELECT * FROM sized WHERE running_tokens <= 8192""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return context.within_budget(_dense_hits(spark, d, 40).join(docs, "chunk_id")).select("query_id", "chunk_id", "rank", "running_tokens")


@query(f"""WITH RECURSIVE {_dense(40)}, sized AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i, chunk_id, text, array_to_string(({_sentences('text')})[1:3], ' ') AS short FROM dense JOIN documents ON doc_id = chunk_id),
walk AS (
  SELECT DISTINCT query_id, 0::BIGINT AS i, 0::BIGINT AS used, FALSE AS done, NULL::BIGINT AS chunk_id, ''::VARCHAR AS kept FROM sized UNION ALL
  SELECT query_id, i, CASE WHEN stop THEN used ELSE total END, stop, chunk_id, CASE WHEN stop THEN NULL ELSE t END FROM (
    SELECT *, done OR total > 8192 AS stop FROM (
      SELECT *, used + length(t) // 4 AS total FROM (
        SELECT s.query_id, s.i, w.used, w.done, s.chunk_id, CASE WHEN w.used + length(s.text) // 4 <= 8192 THEN s.text ELSE s.short END AS t
        FROM walk w JOIN sized s ON s.query_id = w.query_id AND s.i = w.i + 1)))),
kept AS (SELECT * FROM walk WHERE i > 0 AND kept IS NOT NULL)
SELECT query_id, count(*)::INTEGER AS n_items, sha256(string_agg('[chunk_id: ' || chunk_id || '] [source: unknown] [date: unknown]' || chr(10) || kept, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i)) AS prompt_sha FROM kept GROUP BY query_id""")
def compressed_context(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    kept = context.compressed_budget(_dense_hits(spark, d, 40).join(docs, "chunk_id"))
    return kept.select("query_id", F.size("items").alias("n_items"), F.sha2(text.assembled_prompt(F.transform("items", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), F.lit(None).alias("source_name"), F.lit(None).alias("ingestion_ts"), x["text"].alias("text")))), 256).alias("prompt_sha"))


def _lookup_sql(at_least: float) -> str:
    return f"""WITH pairs AS (SELECT q.vec_id AS query_id, e.vec_id AS entry_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 2 = 1 AND q.vec_id % 7 <> 0 AND e.vec_id % 2 = 0)
SELECT query_id, entry_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_id DESC) AS n FROM pairs WHERE similarity >= {at_least}) WHERE n = 1"""


def _lookup(spark: SparkSession, d: str, at_least: float) -> DataFrame:
    v = _vectors(spark, d).withColumn("namespace", F.col("label").cast("string"))
    cache = v.where("chunk_id % 2 = 0").select("namespace", "vector", F.col("chunk_id").alias("entry_id"), F.col("chunk_id").alias("created"))
    asked = v.where("chunk_id % 2 = 1").select(F.col("chunk_id").alias("query_id"), "namespace", "vector", (F.col("chunk_id") % 7 == 0).alias("conversational"))
    return lookup.cache_lookup(asked, cache, at_least)


@query(_lookup_sql(0.25))
def semantic_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _lookup(spark, d, 0.25)


@query(_lookup_sql(0.3))
def semantic_cache_lookup_narrow(spark: SparkSession, d: str) -> DataFrame:
    return _lookup(spark, d, 0.3)


# ---- text ---------------------------------------------------------------------------------------------------------


@query(f"""WITH s AS (SELECT doc_id, text, {_sentences('text')} AS s FROM documents)
SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS normal_sha, len(s)::INTEGER AS n_sentences,
  array_to_string(s[1:3], ' ') AS opening, substr(string_split(text, '.')[1], 1, 80) AS title, len({_words('text')})::INTEGER AS n_words,
  (length(text) // 4)::INTEGER AS budget_tokens, len({_terms('text')})::INTEGER AS n_terms,
  CASE WHEN length(text) < 3 THEN 0 ELSE len(list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)))) END::INTEGER AS n_grams,
  length(trim(text)) >= 20 AS detectable
FROM s""")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "documents").select(
        "doc_id", F.sha2(text.normalize(t), 256).alias("normal_sha"), F.size(text.sentences(t)).alias("n_sentences"),
        text.first_sentences(t).alias("opening"), text.title_of(t).alias("title"), text.token_count(t).alias("n_words"),
        text.budget_tokens(t).alias("budget_tokens"), F.size(text.terms(t)).alias("n_terms"), F.size(text.char_grams(t)).alias("n_grams"),
        predicates.detectable(t).alias("detectable"),
    )


@query("""SELECT doc_id, sha256('paragraph::' || source || '::' || doc_id) AS node_id, substr(sha256(source), 1, 8) AS slug, 'v1.' || doc_id AS version,
  regexp_replace(source || ' / x', '[^\\w\\-]', '_', 'g') AS file_slug,
  CASE WHEN contains(source, 'src1') THEN 'domain-a' WHEN contains(source, 'src2') THEN 'domain-b' WHEN lang <> 'en' THEN 'multilingual' ELSE 'default' END AS model
FROM documents""")
def identifiers(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("source", F.lit("_v1."), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return read(spark, d, "documents").select(
        "doc_id", text.sha("paragraph", F.col("source"), F.col("doc_id").cast("string")).alias("node_id"), text.namespace_slug(F.col("source")).alias("slug"),
        text.version_of(name, F.lit("none")).alias("version"), text.file_slug(F.concat("source", F.lit(" / x"))).alias("file_slug"),
        predicates.embedding_model(F.col("source"), F.col("lang"), [("SRC1", "domain-a"), ("src2", "domain-b")], "multilingual", "default").alias("model"),
    )


@query("""SELECT event_id, date_trunc('quarter', ts)::DATE::VARCHAR AS gte, (date_trunc('quarter', ts) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE::VARCHAR AS lte,
  make_date(year(ts), 1, 1)::VARCHAR AS year_gte, make_date(year(ts), 12, 31)::VARCHAR AS year_lte, json_extract(props, '$.k')::BIGINT AS k FROM events""")
def query_parsing(spark: SparkSession, d: str) -> DataFrame:
    quarter = text.date_range(F.concat(F.lit("sales in Q"), F.quarter("ts").cast("string"), F.lit(" "), F.year("ts").cast("string")))
    year = text.date_range(F.concat(F.lit("report for "), F.year("ts").cast("string")))
    reply = text.json_object(F.concat(F.lit("Here it is: "), "props", F.lit(" as asked.")), "k long")
    return read(spark, d, "events").select("event_id", *[r[c].cast("string").alias(n + c) for n, r in (("", quarter), ("year_", year)) for c in ("gte", "lte")], reply["k"].alias("k"))


@query("""SELECT conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN ' [1], [2] and [1]' ELSE ' [1], [2] and [2]' END AS numbered, (1 + turn % 2)::INTEGER AS first_number, (2 - turn % 2)::INTEGER AS second_number FROM conversations""")
def citation_numbers(spark: SparkSession, d: str) -> DataFrame:
    role, conv, even = F.col("role"), F.col("conv_id").cast("string"), F.col("turn") % 2 == 0
    first, second = F.when(even, role).otherwise(conv), F.when(even, conv).otherwise(role)
    answer = F.concat("text", F.lit(" [CITE:"), first, F.lit("], [CITE:"), second, F.lit("] and [CITE:"), "role", F.lit("]"))
    ids = text.citation_ids(answer)
    return read(spark, d, "conversations").select(
        "conv_id", "turn", text.numbered_citations(answer).alias("numbered"), F.array_position(ids, F.col("role")).cast("int").alias("first_number"),
        F.array_position(ids, F.col("conv_id").cast("string")).cast("int").alias("second_number"),
    )


_FIRSTS = " OR ".join(f"starts_with(t, '{p.replace(chr(39), 2 * chr(39))}')" for p in predicates.UNANSWERED_PREFIXES)


@query(f"""WITH c AS (SELECT *, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS t, len({_words('text')}) AS n FROM conversations)
SELECT conv_id, turn, (text = '' OR {_FIRSTS} OR turn % 10 < 3) AS unanswered, n >= 5 AS wants_hypothesis,
  array_to_string(list_filter([CASE WHEN turn % 10 < 4 THEN 'faithfulness' END, CASE WHEN length(text) < 20 THEN 'too_short' END, CASE WHEN length(text) > 8000 THEN 'too_long' END], lambda x: x IS NOT NULL), ',') AS flags,
  CASE WHEN n <= 256 THEN n / 256 WHEN n >= 512 THEN 0.0 ELSE 1 - (n - 256) / 256 END::DOUBLE AS length_reward FROM c""")
def answer_checks(spark: SparkSession, d: str) -> DataFrame:
    t, faithful = F.col("text"), F.col("turn") % 10 / 10.0
    return read(spark, d, "conversations").select(
        "conv_id", "turn", predicates.unanswered(t, faithful).alias("unanswered"), predicates.wants_hypothesis(t).alias("wants_hypothesis"),
        F.array_join(predicates.answer_flags(t, faithful), ",").alias("flags"), metrics.length_reward(t).alias("length_reward"),
    )


def _redaction_sql() -> str:
    out = "text"
    for name, pattern in dedup.REDACTIONS:
        out = f"regexp_replace({out}, '{pattern}', '<{name}>', 'g')"
    return out


@query(f"SELECT doc_id, CASE WHEN r <> text THEN 'redacted' ELSE 'public' END AS sensitivity, sha256(r) AS fingerprint FROM (SELECT doc_id, text, {_redaction_sql()} AS r FROM documents)")
def pii_redact(spark: SparkSession, d: str) -> DataFrame:
    return dedup.redacted(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", "sensitivity", "fingerprint")


# ---- duplicates, chunks, elements ----------------------------------------------------------------------------------


@query("""SELECT min(doc_id) AS doc_id, h AS content_hash, count(*) AS copies FROM (
  SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS h FROM documents) GROUP BY h""")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_first(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", "content_hash", "copies")


@query(f"""WITH w AS (SELECT doc_id, {_words('text')} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 448)) AS start FROM w WHERE len(w) > 0)
SELECT doc_id, start::INTEGER AS start, least(512, len(w) - start)::INTEGER AS n_tokens, sha256(array_to_string(w[start + 1:start + 512], ' ')) AS text_sha
FROM s WHERE least(512, len(w) - start) >= 50 OR start + 512 >= len(w)""")
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk.fixed_windows(read(spark, d, "documents")).select("doc_id", "start", "n_tokens", F.sha2("text", 256).alias("text_sha"))


@query(f"""WITH s AS (SELECT doc_id, {_sentences('text')} AS s FROM documents), p AS (SELECT doc_id, s, unnest(range(0, len(s))) AS pos FROM s)
SELECT doc_id, pos::INTEGER AS pos, array_to_string(s[pos + 1:pos + 3], ' ') AS text FROM p""")
def sentence_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunk.sentence_windows(read(spark, d, "documents"))


@query(f"""WITH s AS (SELECT doc_id, {_sentences('text')} AS s FROM documents), p AS (SELECT doc_id, s, unnest(range(0, len(s))) AS pos FROM s)
SELECT doc_id, pos::INTEGER AS pos, sha256(array_to_string(s[greatest(pos - 2, 1):pos + 4], ' ')) AS window_sha FROM p""")
def surrounding_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = context.surrounded(chunk.sentence_rows(read(spark, d, "documents")))
    return rows.select("doc_id", "pos", F.sha2("surrounding_text", 256).alias("window_sha"))


@query("""WITH e AS (SELECT source, doc_id, lang, text, CASE WHEN text LIKE '%|%' THEN 'Table' WHEN length(text) < 600 THEN 'Title' WHEN length(text) < 1200 THEN 'ListItem' ELSE 'NarrativeText' END AS category FROM documents),
f AS (SELECT *, CASE category WHEN 'Title' THEN '## ' || text WHEN 'Table' THEN '[TABLE]' || chr(10) || text || chr(10) || '[/TABLE]' WHEN 'ListItem' THEN CASE WHEN starts_with(text, '-') THEN text ELSE '- ' || text END ELSE text END AS part FROM e)
SELECT source AS source_file, lang AS section_key, sha256(string_agg(part, chr(10) || chr(10) ORDER BY doc_id)) AS text_sha, min(doc_id) AS page_start, max(doc_id) AS page_end,
  array_to_string(list_sort(list_distinct(list(category))), ',') AS categories, bool_or(category = 'Table') AS has_table, bool_or(category = 'ListItem') AS has_list,
  count(*) AS element_count, CASE WHEN bool_and(category = 'Table') THEN 'table' ELSE 'text' END AS modality, lang AS language
FROM f GROUP BY source, lang""")
def consolidate_by_source(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    category = F.when(F.col("text").contains("|"), "Table").when(F.length("text") < 600, "Title").when(F.length("text") < 1200, "ListItem").otherwise("NarrativeText")
    elements = docs.select(
        F.col("source").alias("source_file"), F.col("doc_id").alias("pos"), F.col("lang").alias("section"), F.lit(None).cast("string").alias("breadcrumb"),
        category.alias("category"), F.lit(2).alias("depth"), "text", F.col("doc_id").alias("page_number"),
        F.when(category == "Table", "table").otherwise("text").alias("modality"), F.col("lang").alias("language"),
    )
    out = dedup.consolidated(elements)
    return out.select("source_file", "section_key", F.sha2("text", 256).alias("text_sha"), "page_start", "page_end", F.array_join("categories", ",").alias("categories"), "has_table", "has_list", "element_count", "modality", "language")


@query("""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, (generate_subscripts(p, 1) - 1)::INTEGER AS pos, sha256(unnest(p)) AS text_sha FROM p""")
def text_elements(spark: SparkSession, d: str) -> DataFrame:
    return files.text_elements(read(spark, d, "documents")).select("doc_id", "pos", F.sha2("text", 256).alias("text_sha"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), r AS (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS pos, regexp_replace(unnest(l), '^\\s+|\\s+$', '', 'g') AS line FROM l)
SELECT doc_id, pos, sha256(CASE WHEN starts_with(line, '|') THEN line ELSE regexp_replace(line, '^(?:#{1,6}|[-*+]|\\d+[.)])\\s+', '') END) AS text_sha,
  CASE WHEN regexp_matches(line, '^#{1,6}\\s') THEN length(regexp_extract(line, '^(#{1,6})\\s', 1)) END::INTEGER AS depth,
  CASE WHEN regexp_matches(line, '^#{1,6}\\s') THEN 'Title' WHEN regexp_matches(line, '^(?:[-*+]|\\d+[.)])\\s') THEN 'ListItem' WHEN starts_with(line, '|') THEN 'Table' ELSE 'NarrativeText' END AS category
FROM r WHERE line <> ''""")
def markdown_elements(spark: SparkSession, d: str) -> DataFrame:
    return files.markdown_elements(read(spark, d, "documents")).select("doc_id", "pos", "category", F.coalesce("depth", F.lit(None).cast("int")).alias("depth"), F.sha2("text", 256).alias("text_sha"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return files.html_elements(read(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "html"))


@query()
def html_elements(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d)


@query()
def heading_stack(spark: SparkSession, d: str) -> DataFrame:
    return chunk.heading_stack(_pages(spark, d))


@query()
def consolidated_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = chunk.heading_stack(_pages(spark, d))
    return dedup.consolidated(rows.select(F.col("doc_id").cast("string").alias("source_file"), "pos", "section", "breadcrumb", "category", "depth", "text", F.lit(1).alias("page_number"), F.lit("text").alias("modality"), F.lit("").alias("language")))


def _tree_sql() -> str:
    tokens = lambda t: f"len({_words(t).replace('lambda x: x', 'lambda y: y')})"
    packed = f"""list_reduce(list_transform(s, lambda x: [x]), lambda acc, x: CASE WHEN acc[-1] <> '' AND {tokens("acc[-1] || ' ' || x[1]")} > 200 THEN list_concat(acc, [x[1]])
      ELSE list_concat(acc[:-2], [CASE WHEN acc[-1] = '' THEN x[1] ELSE acc[-1] || ' ' || x[1] END]) END, [''])"""
    merged = f"""list_reduce(list_transform(packed, lambda x: [x]), lambda acc, x: CASE WHEN len(acc) > 0 AND {tokens("x[1]")} < 50 THEN list_concat(acc[:-2], [acc[-1] || ' ' || x[1]]) ELSE list_concat(acc, [x[1]]) END, []::VARCHAR[])"""
    strip = "list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
    return f"""WITH p AS (SELECT doc_id, CASE WHEN len({strip}) > 0 THEN {strip} ELSE [text] END AS p FROM documents),
sec AS (SELECT doc_id, unnest(p) AS text, (generate_subscripts(p, 1) - 1) AS no FROM p),
named AS (SELECT *, sha256('section::' || doc_id || '::' || no || '::' || text) AS section_id, {_sentences('text')} AS s FROM sec),
cut AS (SELECT *, {packed} AS packed FROM named),
leaf AS (SELECT *, CASE WHEN len(s) <= 3 AND {tokens('text')} < 50 THEN [text] ELSE {merged} END AS parts FROM cut),
each AS (SELECT doc_id, section_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM leaf)
SELECT sha256('document::' || doc_id) AS node_id, NULL::VARCHAR AS parent_id, 'document' AS level, doc_id, 0 AS pos, {tokens("array_to_string(p, ' ')")}::INTEGER AS n_tokens FROM p
UNION ALL SELECT section_id, sha256('document::' || doc_id), 'section', doc_id, no, {tokens('text')} FROM named
UNION ALL SELECT sha256('paragraph::' || section_id || '::' || pos), section_id, 'paragraph', doc_id, pos, {tokens('part')} FROM each"""


@query(_tree_sql())
def chunk_tree(spark: SparkSession, d: str) -> DataFrame:
    parts = text.held(text.heading_sections(F.col("text")), lambda p: F.when(F.size(p) > 0, p).otherwise(F.array("text")))
    sections = read(spark, d, "documents").select("doc_id", F.posexplode(parts).alias("section_no", "text"))
    return chunk.tree(sections).select("node_id", "parent_id", "level", "doc_id", "pos", text.token_count(F.col("text")).alias("n_tokens"))


_SIMILAR = """sim AS (SELECT label AS doc_id, vec_id AS pos, CASE WHEN nxt IS NOT NULL THEN list_cosine_similarity(embedding::DOUBLE[], nxt::DOUBLE[]) END AS s
  FROM (SELECT label, vec_id, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings)),
cut AS (SELECT *, quantile_cont(s, 0.25) OVER (PARTITION BY doc_id) AS q FROM sim),
seg AS (SELECT *, coalesce(sum(CASE WHEN s < q THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS segment FROM cut)"""


def _segmented(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"), F.concat(F.lit("S"), F.col("vec_id").cast("string")).alias("text"))
    return chunk.segments(chunk.adjacent_similarity(rows))


@query(f"WITH {_SIMILAR} SELECT doc_id, segment, string_agg('S' || pos, ' ' ORDER BY pos) AS text, min(pos) AS first_pos, count(*) AS n_sentences FROM seg GROUP BY doc_id, segment")
def semantic_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segmented(spark, d)


# the parts are strings of words without sentence ends, so none is split; state: the chunks done, then what is carried
_MERGED = """list_reduce(list_transform(parts, lambda x: [x]), lambda acc, x: CASE
  WHEN len(string_split(CASE WHEN acc[-1] = '' THEN x[1] ELSE acc[-1] || ' ' || x[1] END, ' ')) >= 5 THEN list_concat(acc[:-2], [CASE WHEN acc[-1] = '' THEN x[1] ELSE acc[-1] || ' ' || x[1] END, ''])
  ELSE list_concat(acc[:-2], [CASE WHEN acc[-1] = '' THEN x[1] ELSE acc[-1] || ' ' || x[1] END]) END, [''])"""


@query(f"""WITH {_SIMILAR}, s AS (SELECT doc_id, segment, string_agg('S' || pos, ' ' ORDER BY pos) AS text FROM seg GROUP BY doc_id, segment),
p AS (SELECT doc_id, list(text ORDER BY segment) AS parts FROM s GROUP BY doc_id), m AS (SELECT doc_id, {_MERGED} AS acc FROM p),
c AS (SELECT doc_id, CASE WHEN acc[-1] = '' THEN acc[:-2] WHEN len(acc) = 1 THEN acc ELSE list_concat(acc[:-3], [acc[-2] || ' ' || acc[-1]]) END AS chunks FROM m)
SELECT doc_id, (generate_subscripts(chunks, 1) - 1)::INTEGER AS pos, unnest(chunks) AS text FROM c""")
def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk.semantic_chunks(_segmented(spark, d), least=5, most=12)


@query("""WITH t AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, '| ' || n_nationkey || ' | ' || n_name || ' |' AS line FROM nation)
SELECT n_regionkey AS table_id, string_agg(CASE WHEN i = 1 THEN line || chr(10) || '| --- | --- |' ELSE line END, chr(10) ORDER BY i) AS text FROM t GROUP BY n_regionkey""")
def table_markdown(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "nation").select(F.col("n_regionkey").alias("table_id"), F.col("n_nationkey").alias("row_no"), F.array(F.col("n_nationkey").cast("string"), "n_name").alias("cells"))
    return files.table_markdown(rows)


# ---- graph ------------------------------------------------------------------------------------------------------------


@query(f"""SELECT lower(name) AS name, count(DISTINCT doc_id) AS n_chunks, sha256('TERM::' || lower(name)) AS node_id
FROM (SELECT doc_id, unnest({_capitalised('text')}) AS name FROM documents) GROUP BY lower(name)""")
def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    rows = graph.mentions(read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))
    return rows.groupBy("name", "node_id").agg(F.count("*").alias("n_chunks"))


@query("""SELECT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, sum(w) AS weight FROM (
  SELECT l_suppkey, l_partkey, l_returnflag, l_orderkey, sum(l_quantity) AS w FROM lineitem GROUP BY ALL) WHERE l_suppkey <> l_partkey GROUP BY 1, 2""")
def edge_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_returnflag").alias("relation_type"), F.col("l_partkey").alias("target_id"), F.col("l_quantity").alias("weight"), F.col("l_orderkey").alias("chunk_id"))
    return graph.undirected(graph.merge_edges(rows))


@query("""WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY ALL),
c AS (SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY k) AS chunks FROM f GROUP BY o_custkey)
SELECT o_custkey AS node_id, max_by(o_orderstatus, o_orderkey) AS entity_type, max_by(o_totalprice, o_orderkey) AS confidence, min(o_orderkey) AS created, max(o_orderkey) AS updated, any_value(chunks) AS chunks
FROM orders JOIN c USING (o_custkey) GROUP BY o_custkey""")
def entity_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("node_id"), F.lit("x").alias("name"), F.col("o_orderstatus").alias("entity_type"), F.lit("").alias("description"), F.col("o_totalprice").alias("confidence"), F.col("o_orderpriority").alias("chunk_id"), F.col("o_orderkey").alias("seq"))
    return graph.merge_entities(rows).select("node_id", "entity_type", "confidence", "created", "updated", F.array_join("source_chunks", ",").alias("chunks"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Directed edges from customers and suppliers to nations to regions."""
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    parts = [("customer", "c", "c_custkey", "n", "c_nationkey", "IN"), ("supplier", "s", "s_suppkey", "n", "s_nationkey", "IN"), ("nation", "n", "n_nationkey", "r", "n_regionkey", "PART_OF")]
    out = None
    for t, a, ca, b, cb, rel in parts:
        one = read(spark, d, t).select(name(a, ca).alias("source_id"), name(b, cb).alias("target_id"), F.lit(rel).alias("relation_type"), F.lit(1.0).alias("weight"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT 'c' || c_custkey AS start, 'n' || c_nationkey AS node, 1 AS depth FROM customer
UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def khop(spark: SparkSession, d: str) -> DataFrame:
    starts = read(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("start"))
    return graph.neighbours(starts, _places(spark, d), 2)


@query("""WITH e AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation),
x AS (SELECT 'n' || n AS start, 'r' || r AS node, 1 AS depth FROM e UNION ALL SELECT 'n' || a.n, 'n' || b.n, 2 FROM e a JOIN e b ON a.r = b.r AND a.n <> b.n)
SELECT start, node, depth FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth, node) AS k FROM x) WHERE k <= 4""")
def khop_related(spark: SparkSession, d: str) -> DataFrame:
    starts = read(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("start"))
    return graph.neighbours(starts, _places(spark, d), 2, relation="PART_OF", both_ways=True, most=4)


@query("SELECT 'r' || n_regionkey AS start, 'n' || n_nationkey AS source_id, 'r' || n_regionkey AS target_id FROM nation")
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    starts = read(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("start"))
    return graph.induced(starts, _places(spark, d), 1)


@query("""WITH m AS (SELECT 'c' || c_custkey AS node, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 's' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'n' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, r_regionkey FROM region)
SELECT node, min(node) OVER (PARTITION BY r) AS component FROM m""")
def components(spark: SparkSession, d: str) -> DataFrame:
    edges = _places(spark, d)
    nodes = edges.select(F.col("source_id").alias("node")).union(edges.select("target_id"))
    return graph.components(nodes, edges.selectExpr("source_id a", "target_id b"))


@query()
def communities(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.undirected(_places(spark, d))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b"))
    return graph.levels(nodes, edges)


@query(f"""WITH w AS (SELECT DISTINCT unnest({_capitalised('text')}) AS name FROM benchmark), one AS (SELECT min(name) AS name FROM w GROUP BY lower(name)),
n AS (SELECT name, count(*) AS n FROM one JOIN documents ON contains(lower(text), lower(name)) GROUP BY name)
SELECT name, coalesce(n, 0) AS n_chunks, n IS NOT NULL AS covered FROM one LEFT JOIN n USING (name)""")
def entity_coverage(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "benchmark").select(F.explode(text.capital_words(F.col("text"))).alias("name"))
    wanted = names.groupBy(F.lower("name").alias("k")).agg(F.min("name").alias("name")).select("name")
    return graph.entity_coverage(read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), wanted)


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE 'UNKNOWN' END AS label FROM orders""")
def label_registry(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select("o_orderkey", F.lower("o_orderpriority").alias("label"))
    registry = spark.createDataFrame([("1-urgent",), ("2-High",)], "label string")
    return graph.labelled(rows, "label", registry, "UNKNOWN").select("o_orderkey", "label")


# ---- evaluation ------------------------------------------------------------------------------------------------------

_JUDGED = f"""{_dense(50)}, judged AS (SELECT query_id, rank, (a.label = b.label)::INTEGER AS rel FROM dense JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = chunk_id),
relevant AS (SELECT vec_id AS query_id, (SELECT count(*) - 1 FROM embeddings y WHERE y.label = x.label) AS n FROM embeddings x WHERE vec_id % 100 = 0),
found AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) AS hits, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) AS dcg FROM judged GROUP BY query_id),
per AS (SELECT query_id, coalesce(hits, 0) / 10 AS precision, coalesce(hits, 0) / n AS recall, coalesce(1.0::DOUBLE / first, 0) AS rr, (coalesce(hits, 0) > 0)::INTEGER::DOUBLE AS hit,
  coalesce(dcg, 0) / (SELECT sum(1.0::DOUBLE / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n) AS ndcg FROM relevant LEFT JOIN found USING (query_id) WHERE n > 0)"""


def _judged_metrics(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    v = _vectors(spark, d)
    labels = v.select("chunk_id", "label")
    hits = _dense_hits(spark, d, 50).join(labels, "chunk_id")
    asked = labels.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("label").alias("wanted"))
    judged = hits.join(asked, "query_id").withColumn("rel", (F.col("label") == F.col("wanted")).cast("int"))
    sizes = labels.groupBy(F.col("label").alias("wanted")).agg((F.count("*") - 1).alias("n_relevant"))
    return evaluation.judged_metrics(judged, asked.join(sizes, "wanted").select("query_id", "n_relevant"), k)


_ROUNDED = ("precision", "recall", "rr", "hit", "ndcg")


@query(f"WITH {_JUDGED} SELECT query_id, {', '.join(f'round({c}, 9) AS {c}' for c in _ROUNDED)} FROM per")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _judged_metrics(spark, d).select("query_id", *[F.round(c, 9).alias(c) for c in _ROUNDED])


@query(f"WITH {_JUDGED} SELECT {', '.join(f'round(avg({c}), 9) AS {c}' for c in _ROUNDED)}, count(*) AS n_queries FROM per")
def retrieval_report(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.mean_metrics(_judged_metrics(spark, d), *_ROUNDED)
    return out.select(*[F.round(c, 9).alias(c) for c in _ROUNDED], "n_queries")


_RANKED = "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


@query(_RANKED + " SELECT event_type, " + ", ".join(f"max(CASE WHEN i = greatest(1, round_even({p} / 100.0::DOUBLE * n, 0)) THEN value END) AS p{p}" for p in (50, 95, 99)) + ", max(n) AS n FROM r GROUP BY event_type")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.percentiles(read(spark, d, "events"), "value", (50, 95, 99), "event_type")


_REQUESTS = """req AS (SELECT event_id, user_id, event_type, value * 100 AS latency, (value * 40)::INTEGER AS tokens,
  CASE event_type WHEN 'view' THEN 'gpt-4o' WHEN 'click' THEN 'gpt-4o-mini' ELSE 'unknown-model' END AS model FROM events),
priced AS (SELECT *, (tokens * CASE model WHEN 'gpt-4o' THEN 2.5::DOUBLE WHEN 'gpt-4o-mini' THEN 0.15::DOUBLE ELSE 10.0::DOUBLE END + tokens * CASE model WHEN 'gpt-4o' THEN 10.0::DOUBLE WHEN 'gpt-4o-mini' THEN 0.6::DOUBLE ELSE 30.0::DOUBLE END) / 1e6 AS cost FROM req),
checked AS (SELECT *, list_filter([CASE WHEN latency > 10000 THEN 'latency' END, CASE WHEN cost > 0.05 THEN 'cost' END, CASE WHEN tokens > 6000 THEN 'tokens' END], lambda x: x IS NOT NULL) AS v FROM priced)"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select(
        "event_id", "event_type", (F.col("value") * 100).alias("latency"), F.bround(F.col("value") * 40, 0).cast("int").alias("tokens"),
        F.when(F.col("event_type") == "view", "gpt-4o").when(F.col("event_type") == "click", "gpt-4o-mini").otherwise("unknown-model").alias("model"),
    )
    rows = rows.withColumn("cost", metrics.token_cost(F.col("model"), F.col("tokens"), F.col("tokens")))
    return rows.withColumn("violations", predicates.violations(F.col("latency"), F.col("cost"), F.col("tokens")))


@query(f"WITH {_REQUESTS} SELECT event_id, tokens, round(cost, 9) AS cost, array_to_string(v, ',') AS violations FROM checked")
def slo_violations(spark: SparkSession, d: str) -> DataFrame:
    return _requests(spark, d).select("event_id", "tokens", F.round("cost", 9).alias("cost"), F.array_join("violations", ",").alias("violations"))


@query(f"""WITH {_REQUESTS} SELECT event_type, round(avg(cost), 9) AS mean_cost, round(sum(cost), 6) AS total_cost, round(max(cost), 9) AS max_cost, sum(tokens)::BIGINT AS total_tokens,
  round(avg(CASE WHEN len(v) = 0 THEN 1.0 ELSE 0.0 END), 9) AS slo_pass_rate, count(*) AS n FROM checked GROUP BY event_type""")
def cost_report(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.cost_report(_requests(spark, d), "event_type")
    return out.withColumns({"mean_cost": F.round("mean_cost", 9), "total_cost": F.round("total_cost", 6), "max_cost": F.round("max_cost", 9), "slo_pass_rate": F.round("slo_pass_rate", 9)})


@query("""WITH s AS (SELECT user_id, event_type, sum(value) AS ms FROM events GROUP BY ALL)
SELECT user_id AS request_id, round(sum(ms), 6) AS total_ms, count(*)::INTEGER AS n_stages, round(max(CASE WHEN event_type = 'view' THEN ms END), 6) AS view_ms FROM s GROUP BY user_id""")
def stage_times(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").selectExpr("user_id request_id", "event_type stage", "value ms")
    out = evaluation.stage_times(rows)
    return out.select("request_id", F.round("total_ms", 6).alias("total_ms"), F.size("stages").alias("n_stages"), F.round(F.try_element_at("stages", F.lit("view")), 6).alias("view_ms"))


_VARIANTS = f"""v AS (SELECT conv_id, turn, role, list_distinct({_terms('text')}) AS ids FROM conversations),
pairs AS (SELECT a.conv_id, CASE WHEN len(list_distinct(list_concat(a.ids, b.ids))) = 0 THEN 1.0 ELSE len(list_intersect(a.ids, b.ids)) / len(list_distinct(list_concat(a.ids, b.ids))) END::DOUBLE AS j FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.turn < b.turn),
per AS (SELECT conv_id, avg(j) AS j FROM pairs GROUP BY conv_id), g AS (SELECT conv_id, min_by(role, turn) AS dimension FROM v GROUP BY conv_id),
scored AS (SELECT dimension, coalesce(j, 1.0) AS j FROM g LEFT JOIN per USING (conv_id))"""


@query(f"WITH {_VARIANTS} SELECT dimension, round(avg(j), 9) AS mean_jaccard, round(avg(CASE WHEN j >= 0.1 THEN 1.0 ELSE 0.0 END), 9) AS pass_rate, count(*) AS n FROM scored GROUP BY ROLLUP (dimension)")
def fairness_pairwise(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations")
    variants = rows.select(F.col("conv_id").alias("pair_id"), F.col("turn").alias("pos"), F.col("role").alias("label"), F.array_distinct(text.terms(F.col("text"))).alias("ids"))
    groups = rows.groupBy(F.col("conv_id").alias("pair_id")).agg(F.min_by("role", "turn").alias("dimension"))
    out = evaluation.fairness(variants, groups, 0.1)
    return out.withColumns({"mean_jaccard": F.round("mean_jaccard", 9), "pass_rate": F.round("pass_rate", 9)})


@query("""WITH p AS (SELECT label < 5 AS ref, unnest(embedding[1:32])::DOUBLE AS x, generate_subscripts(embedding[1:32], 1) AS i FROM embeddings),
m AS (SELECT ref, i, avg(x) AS m FROM p GROUP BY ref, i), n AS (SELECT ref, i, m / sqrt(sum(m * m) OVER (PARTITION BY ref)) AS u FROM m)
SELECT (SELECT count(*) FROM embeddings WHERE label < 5) AS n_reference, round(sqrt(sum((a.u - b.u) * (a.u - b.u))), 6) AS distance, sqrt(sum((a.u - b.u) * (a.u - b.u))) > 0.15 AS drifted
FROM n a JOIN n b ON a.i = b.i AND a.ref AND NOT b.ref""")
def drift_score(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    out = evaluation.drift(v.where("label < 5"), v.where("label >= 5"))
    return out.withColumn("distance", F.round("distance", 6))


@query("""WITH p AS (SELECT vec_id AS a, lead(vec_id) OVER (ORDER BY vec_id) AS b FROM embeddings), s AS (
  SELECT a, b, CASE WHEN x.label = y.label THEN 'related' ELSE 'unrelated' END AS expected, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS similarity
  FROM p JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b)
SELECT *, CASE WHEN expected = 'related' THEN similarity >= 0.65 ELSE similarity <= 0.35 END AS passed FROM s WHERE b = a + 1""")
def pair_checks(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    after = v.select((F.col("chunk_id") - 1).alias("a"), F.col("chunk_id").alias("b"), F.col("label").alias("lb"))
    pairs = v.select(F.col("chunk_id").alias("a"), F.col("label").alias("la")).join(after, "a")
    return evaluation.pair_checks(pairs.select("a", "b", F.when(F.col("la") == F.col("lb"), "related").otherwise("unrelated").alias("expected")), v)


@query("""WITH t AS (SELECT ts::DATE AS day, sum(value) AS v FROM events GROUP BY 1), l AS (SELECT * FROM t ORDER BY day DESC LIMIT 20),
g AS (SELECT day, CASE WHEN max(v) OVER () = min(v) OVER () THEN 0 ELSE round_even((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 8, 0) END::INTEGER AS i FROM l)
SELECT string_agg(substr(' ▁▂▃▄▅▆▇█', i + 1, 1), '' ORDER BY day) AS trend FROM g""")
def ledger_trend(spark: SparkSession, d: str) -> DataFrame:
    days = read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return evaluation.sparkline(days, "v", "day")


# ---- conversations and datasets ----------------------------------------------------------------------------------------


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").withColumnRenamed("conv_id", "session_id")


@query("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations),
h AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS t FROM b WHERE b <= 6 GROUP BY conv_id)
SELECT conv_id AS session_id, CASE WHEN length(t) > 3000 THEN '...' || right(t, 3000) ELSE t END AS history FROM h""")
def history_window(spark: SparkSession, d: str) -> DataFrame:
    return context.history_window(_turns(spark, d))


@query("""SELECT conv_id AS session_id, turn, CASE WHEN count(*) OVER (PARTITION BY conv_id) > 5 AND row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 3 THEN 'overflow' ELSE 'recent' END AS part FROM conversations""")
def history_split(spark: SparkSession, d: str) -> DataFrame:
    return context.history_split(_turns(spark, d), 5, 3).select("session_id", "turn", "part")


@query("SELECT conv_id AS session_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 4")
def session_cap(spark: SparkSession, d: str) -> DataFrame:
    return context.capped_session(_turns(spark, d), 4).select("session_id", "turn")


@query("SELECT conv_id AS session_id, max_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def redo_last_user(spark: SparkSession, d: str) -> DataFrame:
    return context.last_user_message(_turns(spark, d))


@query("""WITH f AS (SELECT conv_id, text, CASE turn % 3 WHEN 0 THEN 'like' WHEN 1 THEN 'dislike' ELSE 'unknown' END AS rating FROM conversations)
SELECT DISTINCT a.conv_id AS prompt, a.text AS chosen, b.text AS rejected FROM f a JOIN f b ON a.conv_id = b.conv_id AND a.rating = 'like' AND b.rating <> 'like' AND a.text <> b.text
WHERE trim(b.text) <> '' AND trim(a.text) IS NOT NULL""")
def preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    rating = F.when(F.col("turn") % 3 == 0, "like").when(F.col("turn") % 3 == 1, "dislike").otherwise("unknown")
    return datasets.preference_pairs(read(spark, d, "conversations").select(F.col("conv_id").alias("question"), F.col("text").alias("answer"), rating.alias("rating")))


@query(f"""WITH {_dense(50)} SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM dense
JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = chunk_id WHERE a.label <> b.label AND score BETWEEN 0.3 AND 0.85 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5""")
def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    labels = _vectors(spark, d).select("chunk_id", "label")
    hits = _dense_hits(spark, d, 50)
    own = labels.select(F.col("chunk_id").alias("query_id"), F.col("label").alias("wanted"))
    same = hits.join(labels, "chunk_id").join(own, "query_id").where("label = wanted").select("query_id", "chunk_id")
    return datasets.hard_negatives(hits, same, 5)


_PAIRED = """p AS (SELECT conv_id AS query_id, turn AS positive, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE role = 'assistant'),
q AS (SELECT conv_id AS query_id, turn AS negative, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS j, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'user')"""


@query(f"WITH {_PAIRED} SELECT query_id, positive, negative FROM p JOIN q USING (query_id) WHERE j = i % n")
def triplets(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("chunk_id"), "role")
    return datasets.triplets(rows.where("role = 'assistant'"), rows.where("role = 'user'").withColumn("rank", F.col("chunk_id")))


@query()
def random_negatives(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.concat_ws("-", "conv_id", "turn").alias("chunk_id"))
    return datasets.random_negatives(rows, 3)


@query("""WITH b AS (SELECT text AS prompt, min(item_id) AS seq FROM benchmark GROUP BY text), c AS (SELECT text AS prompt, min(conv_id * 1000 + turn) AS seq FROM conversations GROUP BY text)
SELECT prompt, 0 AS source_no, seq FROM c UNION ALL SELECT prompt, 1, seq FROM b WHERE prompt NOT IN (SELECT prompt FROM c WHERE prompt IS NOT NULL)""")
def prompt_pool(spark: SparkSession, d: str) -> DataFrame:
    said = read(spark, d, "conversations").select(F.col("text").alias("prompt"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    return datasets.prompt_pool(said, read(spark, d, "benchmark").select(F.col("text").alias("prompt"), F.col("item_id").alias("seq")))


@query(f"""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ctx FROM conversations),
w AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS r, list_distinct(regexp_extract_all(lower(coalesce(ctx, '')), '[a-z0-9]+')) AS k, len({_words('text')}) AS n FROM c),
s AS (SELECT conv_id, turn, CASE WHEN regexp_matches(text, '\\[\\d+\\]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS citation,
  CASE WHEN len(k) = 0 THEN 1.0 WHEN len(r) = 0 THEN 0.0 ELSE len(list_intersect(r, k)) / len(r) END::DOUBLE AS overlap,
  CASE WHEN n <= 256 THEN n / 256 WHEN n >= 512 THEN 0.0 ELSE 1 - (n - 256) / 256 END::DOUBLE AS length FROM w)
SELECT conv_id, turn, citation, round(overlap, 9) AS overlap, round(length, 9) AS length, round((0.15 * citation + 0.1 * overlap + 0.05 * length) / 0.3, 9) AS reward FROM s""")
def reward_components(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations").withColumn("ctx", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    t, c = F.col("text"), F.col("ctx")
    return rows.select("conv_id", "turn", text.has_citation(t).alias("citation"), F.round(metrics.word_overlap(t, c), 9).alias("overlap"), F.round(metrics.length_reward(t), 9).alias("length"), F.round(metrics.reward(t, c), 9).alias("reward"))


@query("SELECT * EXCLUDE (n) FROM (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return records.upsert(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["user_id", "event_type"], F.col("event_id"))


@query("SELECT DISTINCT source AS namespace FROM documents WHERE source IS NOT NULL")
def namespace_list(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("source is not null").select(F.col("source").alias("namespace")).distinct().orderBy("namespace")
