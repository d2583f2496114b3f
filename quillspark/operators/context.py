"""Context assembly after search: parents, neighbours, order and budget; cache lookups and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import budget_tokens, first_sentences


def expand_parents(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits (query_id, chunk_id, rank, score) replaced by their sections where they are a parent's first hit.

    ``nodes``: (node_id, parent_id). Later hits of the same parent, and hits without one, stay.
    """
    parent = nodes.select(F.col("node_id").alias("chunk_id"), "parent_id")
    first = F.row_number().over(Window.partitionBy("query_id", "parent_id").orderBy("rank"))
    joined = hits.join(parent, "chunk_id", "left").withColumn("_n", first)
    swap = F.col("parent_id").isNotNull() & (F.col("_n") == 1)
    return joined.withColumns({"expanded": swap, "chunk_id": F.when(swap, F.col("parent_id")).otherwise(F.col("chunk_id"))}).drop("_n", "parent_id")


def surrounded(rows: DataFrame, around: int = 3) -> DataFrame:
    """``surrounding_text`` of (doc_id, pos, text): the rows up to ``around`` before and after, in order."""
    frame = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-around, around)
    return rows.withColumn("surrounding_text", F.array_join(F.collect_list("text").over(frame), " "))


def position_order(hits: DataFrame) -> DataFrame:
    """The best first and the second last, the others between; lists of fewer than three stay."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    key = F.when((F.col("rank") == 2) & (n >= 3), n + 1).otherwise(F.col("rank"))
    return hits.withColumn("_key", key).withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("_key"))).drop("_key")


def within_budget(items: DataFrame, budget: int = 8192) -> DataFrame:
    """Items (query_id, rank, text) before the first whose running token total exceeds the budget."""
    total = F.sum(budget_tokens(F.col("text"))).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("running_tokens", total).where(F.col("running_tokens") <= budget)


def compressed_budget(items: DataFrame, budget: int = 8192) -> DataFrame:
    """As ``within_budget``, but an item that overflows is first cut to its opening sentences; one row per query with the items kept."""
    listed = items.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("items"))
    empty = F.filter("items", lambda x: F.lit(False))
    start = F.struct(empty.alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def step(state: Column, item: Column) -> Column:
        fits = state["used"] + budget_tokens(item["text"]) <= budget
        short = first_sentences(item["text"])
        text = F.when(fits, item["text"]).otherwise(short)
        used = state["used"] + budget_tokens(text)
        stop = state["full"] | (used > budget)
        now = F.struct(item["rank"].alias("rank"), item["chunk_id"].alias("chunk_id"), text.alias("text"))
        return F.struct(
            F.when(stop, state["kept"]).otherwise(F.concat(state["kept"], F.array(now))).alias("kept"),
            F.when(stop, state["used"]).otherwise(used).alias("used"),
            stop.alias("full"),
        )

    return listed.select("query_id", F.aggregate("items", start, step, lambda s: s["kept"]).alias("items"))


def fetch(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks for (query_id, chunk_id, ordinal) in that order, scored by 1 / rank of those that exist."""
    joined = ids.join(chunks, "chunk_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("ordinal"))
    return joined.withColumn("rank", rank).withColumn("score", 1.0 / F.col("rank")).drop("ordinal")


def merge_distinct(first: DataFrame, second: DataFrame) -> DataFrame:
    """Items of both (query_id, chunk_id, text, rank): all of the first, and those of the second whose key it lacks."""
    key = F.coalesce("chunk_id", F.substring("text", 1, 80))
    a, b = first.withColumn("_key", key), second.withColumn("_key", key)
    return a.unionByName(b.join(a.select("query_id", "_key"), ["query_id", "_key"], "left_anti")).drop("_key")


def history_split(turns: DataFrame, most: int = 14, keep: int = 6) -> DataFrame:
    """Turns (session_id, turn, role, text) marked ``recent`` or, in sessions of more than ``most``, ``overflow`` to be summarised."""
    session = Window.partitionBy("session_id")
    back = F.row_number().over(session.orderBy(F.desc("turn")))
    return turns.withColumn("part", F.when((F.count("*").over(session) > most) & (back > keep), "overflow").otherwise("recent"))


def history_window(turns: DataFrame, last: int = 6, chars: int = 3000) -> DataFrame:
    """The last turns of each session as one text, cut to its last characters after an ellipsis."""
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))
    recent = turns.withColumn("_b", back).where(F.col("_b") <= last)
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n")
    out = recent.groupBy("session_id").agg(text.alias("t"))
    return out.select("session_id", F.when(F.length("t") > chars, F.concat(F.lit("..."), F.expr(f"right(t, {chars})"))).otherwise(F.col("t")).alias("history"))


def capped_session(turns: DataFrame, most: int = 40) -> DataFrame:
    """The last ``most`` messages of each session."""
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn")))
    return turns.withColumn("_b", back).where(F.col("_b") <= most).drop("_b")


def last_user_message(turns: DataFrame) -> DataFrame:
    """The last user message of each session, which a redo repeats."""
    return turns.where("role = 'user'").groupBy("session_id").agg(F.max_by("text", "turn").alias("text"))


def citations(answers: DataFrame, chunks: DataFrame, excerpt: int = 200) -> DataFrame:
    """Citations of ``answers`` (answer_id, answer): number, chunk_id, source and excerpt; unknown ids keep nulls."""
    from quillspark.functions.text import citation_ids

    cited = answers.select("answer_id", F.posexplode(citation_ids(F.col("answer"))).alias("p", "chunk_id"))
    return cited.join(chunks, "chunk_id", "left").select("answer_id", (F.col("p") + 1).alias("number"), "chunk_id", "source_name", F.substring("text", 1, excerpt).alias("excerpt"))
