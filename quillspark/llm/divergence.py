"""Source divergence audit: how far the sources of a language differ in the words they use, by relational steps only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import materialize, shuffle_parts, table

#: Runs of ASCII letters and of characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: The same in lowered texts, in the form that Java's patterns test fastest.
LOWERED_TERM = r"[a-z\x{80}-\x{10FFFF}]+"
#: Documents of a language that must hold a kept term; the count added to each term; the scale of shares; ranks of terms.
MIN_DOCS, SMOOTHING, SCALE, RANKS = 30, 5, 1_000_000_000, 50
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case; texts in ASCII take the cheaper way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UP, _LOW))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): occurrences of each term, and documents that hold it, from one pass.

    A text's terms are sorted, so that the first of equal ones marks its document; tasks sum before the shuffle.
    """
    listed = docs.select("lang", "source", F.sort_array(F.regexp_extract_all(lowered(F.col("text")), F.lit(LOWERED_TERM), F.lit(0))).alias("t"))
    each = listed.select("lang", "source", "t", F.posexplode("t").alias("pos", "term"))
    first = ~F.get("t", F.col("pos") - 1).eqNullSafe(F.col("term"))
    return each.groupBy("lang", "source", "term").agg(F.count("*").alias("count"), F.count_if(first).alias("docs"))


def _share(count: str, total: str, smoothing: int) -> Column:
    """1 + floor(SCALE * (count + smoothing) / (total + smoothing * v)) in whole numbers; 0 where no term is kept."""
    wide = "cast({} as decimal(38, 0))"
    return F.expr(f"coalesce(1 + {wide.format(f'{SCALE}L')} * ({count} + {smoothing}) div nullif({total} + {smoothing} * v, 0), 0)")


def dense_shares(docs: DataFrame, min_docs: int = MIN_DOCS, smoothing: int = SMOOTHING) -> DataFrame:
    """(lang, source, term, count, p, q) of every group and every kept term of its language, counts of 0 included; p is
    the group's share and q the language's. A language without kept terms has one row per group: no term, shares 0."""
    spark = docs.sparkSession
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = materialize(term_counts(docs), "term-counts")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs"))
    kept = materialize(vocabulary.where(F.col("docs") >= min_docs).drop("docs"), "kept")
    used = materialize(counts.join(kept.select("lang", "term"), ["lang", "term"]).drop("docs"), "used")
    # one row for each group, with what all its rows share
    groups = docs.select("lang", "source").distinct().join(used.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    groups = materialize(groups.join(langs, "lang", "left").fillna(0, ["n", "v", "n_lang"]), "groups")
    bare = groups.where("v = 0").select("lang", F.lit("").alias("term"), F.lit(0).cast("long").alias("total")).distinct()
    # a language may hold most terms: its terms are dealt to parts by a hash, and its few groups go to each part
    parts = shuffle_parts(spark)
    dealt = kept.union(bare).withColumn("part", F.pmod(F.hash("term"), F.lit(parts)))
    crossed = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(dealt, ["lang", "part"])
    filled = crossed.join(used, ["lang", "source", "term"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    shares = filled.select("lang", "source", "term", "count", _share("count", "n", smoothing).alias("p"), _share("total", "n_lang", smoothing).alias("q"))
    return materialize(shares, "shares")


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, smoothing: int = SMOOTHING, ranks: int = RANKS) -> DataFrame:
    """Divergences of the (lang, source) groups of ``docs`` (text, lang, source): (lang, source, part, item, value, rank).

    Part ``pair``: for each other source of the language, the sum over the kept terms of the absolute difference of
    shares, all ranks. Part ``term``: the ``ranks`` kept terms that occur in the group whose share most exceeds the
    language's. Null text, lang and source are empty strings; a group without terms, or of a language that keeps none,
    still has its pairs (with 0 in the latter case). Repeated rows count each; a term is counted by rows. Ties go to
    the smaller item in UTF-8. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    shares = dense_shares(docs, min_docs, smoothing)
    one, two = shares.select("lang", "term", "source", "p"), shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    sums = one.join(two, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("lang", ways.alias("way"), "value").select("lang", "way.source", "way.item", "value")
    terms = shares.where("count > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs, terms = pairs.withColumn("rank", rank), terms.withColumn("rank", rank).where(F.col("rank") <= ranks)
    columns = [F.col(c) for c in ("item", "value", "rank")]
    return pairs.select("lang", "source", F.lit("pair").alias("part"), *columns).unionByName(terms.select("lang", "source", F.lit("term").alias("part"), *columns))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all ``documents``. Cases as in ``source_divergence``."""
    return source_divergence(table(spark, sf_dir, "documents", "text", "lang", "source"))


def op13_sql(min_docs: int = MIN_DOCS) -> str:
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{TERM}') AS t FROM documents),
each AS (SELECT r, lang, source, unnest(t) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM each GROUP BY lang, term HAVING count(DISTINCT r) >= {min_docs}),
counts AS (SELECT lang, source, term, count(*) AS n FROM each GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
dense AS (
  SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
summed AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source) AS n_group, count(*) OVER (PARTITION BY lang, source) AS v,
    sum(total) OVER (PARTITION BY lang, source) AS n_lang FROM dense),
shares AS (
  SELECT lang, source, term, n, 1 + {SCALE}::HUGEINT * (n + {SMOOTHING}) // (n_group + {SMOOTHING} * v)::HUGEINT AS p,
    1 + {SCALE}::HUGEINT * (total + {SMOOTHING}) // (n_lang + {SMOOTHING} * v)::HUGEINT AS q FROM summed),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b USING (lang, term)
  WHERE a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {RANKS}
"""
