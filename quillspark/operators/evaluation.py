"""Retrieval, system, cost, drift, fairness and conversation metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import jaccard
from quillspark.tables import staged


def retrieval_metrics(results: DataFrame, qrels: DataFrame, k: int = 10, cut: bool = False) -> DataFrame:
    """Per query of ``qrels`` (query_id, chunk_id): precision, recall and hit at k, reciprocal rank and NDCG of ``results`` (query_id, chunk_id, rank)."""
    relevant = qrels.distinct()
    judged = results.join(relevant.withColumn("rel", F.lit(1)), ["query_id", "chunk_id"], "left").fillna({"rel": 0})
    return judged_metrics(judged, relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant")), k, cut)


def judged_metrics(judged: DataFrame, relevant: DataFrame, k: int = 10, cut: bool = False) -> DataFrame:
    """The same from judged results (query_id, rank, rel 0/1) and the number of relevant chunks (query_id, n_relevant).

    With ``cut`` the reciprocal rank, too, looks at the first ``k`` only.
    """
    top = F.col("rank") <= k
    judged = judged.where(top) if cut else judged
    found = judged.groupBy("query_id").agg(
        F.sum(F.when(top, F.col("rel")).otherwise(0)).alias("hits"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(top, F.col("rel") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    rows = relevant.where("n_relevant > 0").join(found, "query_id", "left").fillna({"hits": 0, "dcg": 0.0})
    return rows.select(
        "query_id",
        (F.col("hits") / k).alias("precision"), (F.col("hits") / F.col("n_relevant")).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), (F.col("hits") > 0).cast("double").alias("hit"),
        (F.col("dcg") / ideal).alias("ndcg"),
    )


def mean_metrics(per_query: DataFrame, *columns: str) -> DataFrame:
    """Means over all queries; 0 where there is nothing to average."""
    return per_query.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns], F.count("*").alias("n_queries"))


def lift(system: DataFrame, baseline: DataFrame, metric: str) -> DataFrame:
    """Difference of a metric's means between two per-query tables."""
    a, b = system.agg(F.avg(metric).alias("system")), baseline.agg(F.avg(metric).alias("baseline"))  # one row each
    return a.crossJoin(b).withColumn("lift", F.col("system") - F.col("baseline"))


def percentiles(rows: DataFrame, value: str, ps: tuple[float, ...], *by: str) -> DataFrame:
    """Nearest-rank percentiles per group, exact, from the counts of distinct values.

    The values are dealt out by ranges, so a large group is sorted in many tasks; a table of each group's totals by
    range says how many values lie below each range.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    ranged = staged(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "_part").agg(F.sum("c").alias("own"))  # a row per group and range
    group = Window.partitionBy(*by)
    totals = totals.withColumns({"n": F.sum("own").over(group), "before": F.sum("own").over(group.orderBy("_part")) - F.col("own")})
    within = F.sum("c").over(Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranged.withColumn("within", within).join(totals, [*by, "_part"]).withColumn("upto", F.col("before") + F.col("within"))

    def at(p: float) -> Column:
        rank = F.least(F.col("n"), F.greatest(F.lit(1), F.bround(F.lit(p / 100.0) * F.col("n"), 0).cast("long")))
        return F.min(F.when(F.col("upto") >= rank, F.col(value)))

    return ranked.groupBy(*by).agg(*[at(p).alias(f"p{p:g}".replace(".", "_")) for p in ps], F.max("n").alias("n"))


def cost_report(records: DataFrame, *by: str) -> DataFrame:
    """Mean, total and largest cost, tokens, and the share of records without violations (1 of none)."""
    met = (F.size("violations") == 0).cast("double")
    return records.groupBy(*by).agg(
        F.avg("cost").alias("mean_cost"), F.sum("cost").alias("total_cost"), F.max("cost").alias("max_cost"),
        F.sum("tokens").alias("total_tokens"), F.coalesce(F.avg(met), F.lit(1.0)).alias("slo_pass_rate"), F.count("*").alias("n"),
    )


def stage_times(rows: DataFrame) -> DataFrame:
    """Latency by stage of (request_id, stage, ms) as a map; repeated stages add up."""
    sums = rows.groupBy("request_id", "stage").agg(F.sum("ms").alias("ms"))
    return sums.groupBy("request_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "ms")))).alias("stages"), F.sum("ms").alias("total_ms"))


#: The token counters of a request, which its total adds up.
TOKEN_COUNTERS = ("prompt_tokens", "completion_tokens", "judge_prompt_tokens", "judge_completion_tokens", "embedding_tokens")


def total_tokens(records: DataFrame) -> DataFrame:
    """``records`` with the sum of those token counters that they have; null counters are 0."""
    have = [F.coalesce(F.col(c), F.lit(0)) for c in TOKEN_COUNTERS if c in records.columns]
    return records.withColumn("total_tokens", sum(have, F.lit(0)))


def numbered(rows: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """``rows`` numbered from 1 within ``by`` in the order of ``order``; a large group is numbered in many tasks, from the
    counts of its ranges."""
    ranged = staged(rows.repartitionByRange(by, order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(by, "_part").agg(F.count("*").alias("_own"))  # a row per group and range
    before = counts.withColumn("_before", F.sum("_own").over(Window.partitionBy(by).orderBy("_part")) - F.col("_own")).drop("_own")
    within = F.row_number().over(Window.partitionBy(by, "_part").orderBy(order))
    placed = ranged.withColumn(name, within).join(before, [by, "_part"])
    return placed.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_part", "_before")


def rolling_drift(rows: DataFrame, every: int = 100, width: int = 1000, recent: int = 20, dims: int = 32, threshold: float = 0.15) -> DataFrame:
    """Drift checks over (namespace, seq, vector): after each ``every`` vectors of a namespace the mean of the last
    ``recent`` against the mean of the last ``width``, both cut to ``dims`` and normalised: (namespace, seen, distance, drifted).

    Vectors are summed in blocks that all three lengths are multiples of; only the sums are read in order. A seq is a key
    of its namespace, which isn't null.
    """
    block = math.gcd(every, width, recent)
    parts = numbered(rows.select("namespace", "seq", "vector"), "namespace", "seq", "seen")
    parts = parts.withColumn("block", F.ceil(F.col("seen") / block).cast("long"))
    columns = [F.sum(F.get("vector", F.lit(i)).cast("double")).alias(f"x{i}") for i in range(dims)]
    sums = parts.groupBy("namespace", "block").agg(F.count("*").alias("n"), F.array(*columns).alias("x")).select("namespace", "block", "n", F.posexplode("x").alias("d", "x"))
    last = lambda most: Window.partitionBy("namespace", "d").orderBy("block").rowsBetween(1 - most // block, 0)
    mean = lambda most: F.sum("x").over(last(most)) / F.sum("n").over(last(most))
    means = sums.select("namespace", (F.col("block") * block).alias("seen"), "n", mean(width).alias("a"), mean(recent).alias("b"))
    means = means.where((F.col("seen") % every == 0) & (F.col("n") == block))
    per = means.groupBy("namespace", "seen").agg(F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"), F.sum(F.col("a") * F.col("b")).alias("ab"))
    cosine = F.col("ab") / (F.sqrt("aa") * F.sqrt("bb"))
    distance = F.sqrt(F.greatest(2 - 2 * cosine, F.lit(0.0)))  # of two unit vectors
    return per.select("namespace", "seen", distance.alias("distance"), (distance > threshold).alias("drifted"))


def drift(reference: DataFrame, recent: DataFrame, dims: int = 32, threshold: float = 0.15, least: int = 50) -> DataFrame:
    """Distance of the two normalised mean vectors over the first ``dims`` components; no verdict below ``least`` references."""

    def means(rows: DataFrame, name: str) -> DataFrame:
        parts = rows.select(F.posexplode(F.slice("vector", 1, dims)).alias("d", "x"))
        mean = parts.groupBy("d").agg(F.avg(F.col("x").cast("double")).alias("m"))
        norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy()))  # at most ``dims`` rows
        return mean.select("d", F.when(norm > 0, F.col("m") / norm).otherwise(F.col("m")).alias(name))

    gap = means(reference, "a").join(means(recent, "b"), "d").agg(F.sqrt(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))).alias("distance"))
    n = reference.agg(F.count("*").alias("n_reference"))
    return gap.crossJoin(n).select("n_reference", "distance", F.when(F.col("n_reference") >= least, F.col("distance") > threshold).alias("drifted"))


def variant_pairs(variants: DataFrame) -> DataFrame:
    """All pairs of a group's variants (pair_id, pos, label, ids) in list order."""
    a = variants.select("pair_id", F.col("pos").alias("pa"), F.col("label").alias("a"), F.col("ids").alias("ia"))
    b = variants.select("pair_id", F.col("pos").alias("pb"), F.col("label").alias("b"), F.col("ids").alias("ib"))
    return a.join(b, "pair_id").where("pa < pb").withColumn("jaccard", jaccard(F.col("ia"), F.col("ib")))


def fairness(variants: DataFrame, groups: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Mean pairwise Jaccard by group (1 without pairs), then by dimension and overall (dimension null): mean, pass rate, n."""
    per = variant_pairs(variants).groupBy("pair_id").agg(F.avg("jaccard").alias("j"))
    scored = groups.select("pair_id", "dimension").join(per, "pair_id", "left").withColumn("j", F.coalesce("j", F.lit(1.0)))
    return scored.rollup("dimension").agg(F.avg("j").alias("mean_jaccard"), F.avg((F.col("j") >= threshold).cast("double")).alias("pass_rate"), F.count("*").alias("n"))


def conversation_report(turns: DataFrame) -> DataFrame:
    """Rates over (expects_condensation, condensed, retrieved, coverage, conflict): condensation over the turns that expect it."""
    passed = (F.col("condensed") | ~F.col("expects_condensation")) & F.col("retrieved") & ~F.col("conflict")
    return turns.agg(
        F.avg(F.when(F.col("expects_condensation"), F.col("condensed").cast("double"))).alias("condensation_rate"),
        F.avg(F.col("retrieved").cast("double")).alias("retrieval_rate"), F.avg("coverage").alias("mean_coverage"),
        (1 - F.avg(F.col("conflict").cast("double"))).alias("coherence"), F.bool_and(passed).alias("all_passed"),
    )


def coherence_report(rows: DataFrame, low: float = 0.6) -> DataFrame:
    """Mean of (chunk_id, coherence) and the number of chunks below ``low``, which ``incoherent`` lists."""
    return rows.agg(F.coalesce(F.avg("coherence"), F.lit(0.0)).alias("mean_coherence"), F.count_if(F.col("coherence") < low).alias("n_low"))


def incoherent(rows: DataFrame, low: float = 0.6) -> DataFrame:
    """The chunks (chunk_id, coherence) below ``low``."""
    return rows.where(F.col("coherence") < low)


def pair_checks(pairs: DataFrame, vectors: DataFrame, related: float = 0.65, unrelated: float = 0.35) -> DataFrame:
    """Cosine of pairs (a, b, expected) and whether related ones are near and unrelated ones far."""
    from quillspark.functions.metrics import cosine

    x, y = vectors.select(F.col("chunk_id").alias("a"), F.col("vector").alias("va")), vectors.select(F.col("chunk_id").alias("b"), F.col("vector").alias("vb"))
    scored = pairs.join(x, "a").join(y, "b").withColumn("similarity", F.round(cosine(F.col("va"), F.col("vb")), 6))
    ok = F.when(F.col("expected") == "related", F.col("similarity") >= related).otherwise(F.col("similarity") <= unrelated)
    return scored.select("a", "b", "expected", "similarity", ok.alias("passed"))


def text_pair_checks(pairs: DataFrame, texts: DataFrame, most: int = 512, related: float = 0.65, unrelated: float = 0.35) -> DataFrame:
    """``pair_checks`` of pairs (a, b, expected) of ``texts`` (chunk_id, text), whose first ``most`` characters are embedded."""
    from quillspark.plans.models import embedded

    opening = texts.select("chunk_id", F.substring(F.coalesce("text", F.lit("")), 1, most).alias("text"))
    return pair_checks(pairs, embedded(opening, "text", "vector"), related, unrelated)


GLYPHS = "▁▂▃▄▅▆▇█"


def sparkline(ledger: DataFrame, value: str, order: str, last: int = 20, glyphs: str = " " + GLYPHS) -> DataFrame:
    """The last values of a ledger as one line of glyphs, scaled between their least and greatest."""
    recent = ledger.select(order, value).orderBy(F.desc(order)).limit(last)
    whole = Window.partitionBy()  # at most ``last`` rows
    low, high = F.min(value).over(whole), F.max(value).over(whole)
    level = F.when(high == low, F.lit(0)).otherwise(F.bround((F.col(value) - low) / (high - low) * (len(glyphs) - 1), 0)).cast("int")
    lines = recent.select(order, F.substring(F.lit(glyphs), level + 1, F.lit(1)).alias("g"))
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "g"))), lambda x: x["g"]), "").alias("trend"))
