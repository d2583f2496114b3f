from pyspark.sql import functions as F

from quillspark.functions import metrics, predicates, text


def one(spark, **columns):
    names, values = zip(*columns.items(), strict=True)
    return spark.createDataFrame([values], ", ".join(f"{n} {t}" for n, t in zip(names, (kind(v) for v in values), strict=True)))


def kind(v):
    if isinstance(v, list):
        return f"array<{kind(v[0]) if v else 'string'}>"
    return {str: "string", float: "double", int: "long", bool: "boolean", type(None): "string"}[type(v)]


def value(spark, column, **columns):
    return one(spark, **columns).select(column.alias("x")).first()["x"]


def test_sentences(spark):
    s = lambda t: value(spark, text.sentences(F.col("t")), t=t)
    assert s("First one. Second one! Third?") == ["First one.", "Second one!", "Third?"]
    assert s("Dr. Smith came. He left.") == ["Dr. Smith came.", "He left."]
    assert s("") == []
    assert s("  Padded here.   Next 1 \n") == ["Padded here.", "Next 1"]


def test_sentences_around_tables(spark):
    t = "One. Two.\n| a | b |\n| 1 | 2 |\nThree."
    assert value(spark, text.sentences_around_tables(F.col("t")), t=t) == ["One.", "Two.", "| a | b |\n| 1 | 2 |", "Three."]


def test_sections_and_heading(spark):
    assert len(value(spark, text.heading_sections(F.col("t")), t="# A\nx\n## B\ny\n# C\nz")) == 3
    assert value(spark, text.heading_sections(F.col("t")), t="a\n\nb") == ["a", "b"]
    h = value(spark, text.heading(F.col("t")), t="x\n## Title here\ny")
    assert (h["text"], h["depth"]) == ("Title here", 2)


def test_citations(spark):
    t = "a [CITE:x1] b [CITE:0] c [CITE:x1]"
    assert value(spark, text.numbered_citations(F.col("t")), t=t) == "a [1] b [2] c [1]"
    assert value(spark, text.citation_ids(F.col("t")), t=t) == ["x1", "0"]
    assert value(spark, text.has_citation(F.col("t")), t="a [3]") == 1.0


def test_whole_words(spark):
    assert not value(spark, text.has_phrase(F.col("t"), F.lit("it")), t="digital assessment")
    assert value(spark, text.has_phrase(F.col("t"), F.lit("it (is)")), t="say it (is)") is False  # a bracket ends no word
    assert value(spark, text.condensed(F.col("t"), F.array(F.lit("rate")), F.array(F.lit("it"))), t="the rate of digits")


def test_numbered_lines_dates_versions(spark):
    assert value(spark, text.numbered_lines(F.col("t")), t="1. a\n2) b\n\n3. c\n4. d\n5. e") == ["a", "b", "c", "d"]
    r = value(spark, text.date_range(F.col("t")), t="results of Q2 2024")
    assert (str(r["gte"]), str(r["lte"])) == ("2024-04-01", "2024-06-30")
    assert value(spark, text.date_range(F.col("t")), t="no date") is None
    assert value(spark, text.version_of(F.col("t"), F.lit("d")), t="report_v1.2.pdf") == "v1.2"
    assert value(spark, text.version_of(F.col("t"), F.lit("d")), t="report.pdf") == "d"


def test_model_replies(spark):
    assert value(spark, text.json_object(F.col("t"), "k long")["k"], t='noise {"k": 3} tail') == 3
    assert value(spark, text.json_object(F.col("t"), "k long"), t="nothing") is None
    p = value(spark, text.preference_reply(F.col("t")), t="short answers|REDO")
    assert tuple(p) == ("set", "short answers", "REDO")
    assert value(spark, text.preference_reply(F.col("t"))["action"], t="CLEAR") == "clear"


def test_grams_jaccard(spark):
    assert value(spark, text.char_grams(F.col("t")), t="ab") == []
    assert value(spark, text.char_grams(F.col("t")), t="abcd") == ["abc", "bcd"]
    assert value(spark, text.jaccard(F.col("a"), F.col("b")), a=["a", "b"], b=["b", "c"]) == 1 / 3
    assert value(spark, text.jaccard(F.col("a"), F.col("b")), a=[], b=[]) == 1.0


def test_percentile_cost_reward(spark):
    p = lambda v, q: value(spark, metrics.nearest_rank(F.col("v"), q), v=v)
    assert p([42.0], 50) == 42.0
    assert p([10.0, 20.0, 30.0, 40.0, 50.0], 50) == 20.0  # rank 2.5 rounds to the even 2
    assert p([10.0, 20.0, 30.0], 99) == 30.0
    cost = metrics.token_cost(F.col("m"), F.lit(1_000_000), F.lit(1_000_000))
    assert value(spark, cost, m="gpt-4o-mini") == 0.75
    assert value(spark, cost, m="never heard of") == 40.0
    assert value(spark, metrics.rerank_cost(F.lit(1000)), m="x") == 2.0
    assert value(spark, metrics.word_overlap(F.col("r"), F.col("c")), r="a b c", c="b c d") == 2 / 3
    assert value(spark, metrics.length_reward(F.col("t")), t=" ".join(["w"] * 256)) == 1.0
    assert value(spark, metrics.length_reward(F.col("t")), t=" ".join(["w"] * 512)) == 0.0
    assert value(spark, metrics.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0]) == 0.0


def test_predicates(spark):
    assert value(spark, predicates.unanswered(F.col("t"), F.lit(None).cast("double")), t="  I could not find it")
    assert value(spark, predicates.unanswered(F.col("t"), F.lit(0.2)), t="Fine")
    assert not value(spark, predicates.unanswered(F.col("t"), F.lit(0.9)), t="Fine")
    assert value(spark, predicates.violations(F.lit(20_000), F.lit(0.01), F.lit(7000)), t="") == ["latency", "tokens"]
    assert value(spark, predicates.violations(F.lit(20_000), F.lit(0.01), F.lit(7000), enabled=False), t="") == []
    assert value(spark, predicates.preference_kind(F.col("t")), t="please clear your preferences") == "clear"
    assert value(spark, predicates.preference_kind(F.col("t")), t="what is the rate of this") == "null"
    assert value(spark, predicates.preference_kind(F.col("t")), t="shorter answers") is None


def test_decoding(spark):
    rows = spark.createDataFrame([(1, bytearray("é".encode())), (2, bytearray(b"\xe9")), (3, bytearray(b"\xef\xbb\xbfa"))], "i int, b binary")
    assert [r["t"] for r in rows.select("i", text.decoded(F.col("b")).alias("t")).orderBy("i").collect()] == ["é", "é", "a"]


def test_char_grams_in_one_scan(spark):
    grams = text.char_grams(F.col("t"))
    assert value(spark, grams, t="a\U0001f600b\U0001f600\n\u00e9") == ["a\U0001f600b", "\U0001f600b\U0001f600", "b\U0001f600\n", "\U0001f600\n\u00e9"]
    assert value(spark, grams, t="aaaa") == ["aaa"] and value(spark, grams, t="") == []
    assert value(spark, text.char_grams(F.col("t"), 2), t="abab") == ["ab", "ba"]
    assert "lambda" not in str(grams)  # no array of all characters, no expression run for each gram
