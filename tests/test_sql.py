import pytest
from pyspark.sql import functions as F

from quillspark import sql
from quillspark.functions import metrics, text
from quillspark.operators import chunk
from quillspark.queries import read
from quillspark.sources import files


@pytest.fixture(scope="module")
def session(spark):
    sql.register(spark)
    return spark


def same(a, b):
    assert a.columns == b.columns and sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_one_statement_chunks_documents(session):
    docs = read(session, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    docs.createOrReplaceTempView("docs_to_chunk")
    got = session.sql("SELECT * FROM word_windows(TABLE(SELECT doc_id, text FROM docs_to_chunk) PARTITION BY (doc_id), 512, 64, 50)")
    same(got, chunk.fixed_windows(docs))


def test_windows_of_odd_texts(session):
    docs = session.createDataFrame([("a", "one two  three\tfour"), ("b", None), ("c", " \n "), ("d", "x"), ("a", "a second row")], "doc_id string, text string")
    docs.createOrReplaceTempView("odd_docs_to_chunk")
    got = session.sql("SELECT * FROM word_windows(TABLE(odd_docs_to_chunk) PARTITION BY (doc_id), 3, 1, 2) ORDER BY doc_id")
    same(got, chunk.fixed_windows(docs, 3, 1, 2))
    with pytest.raises(Exception, match="overlap must be"):
        session.sql("SELECT * FROM word_windows(TABLE(odd_docs_to_chunk) PARTITION BY (doc_id), 3, 3, 2)").collect()
    with pytest.raises(Exception, match="needs a column text"):
        session.sql("SELECT * FROM word_windows(TABLE(SELECT doc_id FROM odd_docs_to_chunk), 3, 1, 2)").collect()


def test_html_elements_in_sql(session):
    pages = session.createDataFrame([(1, "<h2>T</h2><p>a <b>b</b></p><ul><li>x</li></ul>"), (2, None)], "doc_id long, text string")
    pages.createOrReplaceTempView("pages_to_parse")
    got = session.sql("SELECT * FROM html_elements(TABLE(pages_to_parse) PARTITION BY (doc_id))")
    same(got, files.html_elements(pages.withColumnRenamed("text", "html")))


def test_scalars_equal_the_column_functions(session):
    rows = session.createDataFrame(
        [("Ein  Ä, b c d", 3, [1.0, 2.0], [2.0, 1.0]), ("", 300, [0.0, 0.0], [1.0, 1.0]), ("ab", 900, [1.0], [1.0])], "t string, n int, a array<double>, b array<double>"
    )
    rows.createOrReplaceTempView("scalar_rows")
    got = session.sql("SELECT normalized(t) x1, search_terms(t) x2, text_words(t) x3, array_sort(char_grams(t, 3)) x4, jaccard(search_terms(t), text_words(t)) x5, cosine(a, b) x6, length_reward(n) x7, rrf_part(3, 60) x8 FROM scalar_rows")
    t = F.col("t")
    want = rows.select(
        text.normalize(t).alias("x1"), text.terms(t).alias("x2"), text.words(t).alias("x3"), F.array_sort(text.char_grams(t)).alias("x4"), text.jaccard(text.terms(t), text.words(t)).alias("x5"),
        metrics.cosine(F.col("a"), F.col("b")).alias("x6"), F.when(F.col("n") <= 256, F.col("n") / 256).when(F.col("n") >= 512, 0.0).otherwise(1 - (F.col("n") - 256) / 256).alias("x7"), F.lit(1 / 63).alias("x8"),
    )
    for a, b in zip(sorted(map(tuple, got.collect()), key=repr), sorted(map(tuple, want.collect()), key=repr), strict=True):
        assert a[:4] == b[:4] and all(abs(x - y) < 1e-12 for x, y in zip(a[4:], b[4:], strict=True))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
