"""Model steps as plans: the prompt column, the call, and the reply parsed into columns, with what stands where a reply fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.predicates import detectable
from quillspark.functions.text import json_object, non_empty, numbered_lines
from quillspark.plans.models import Task, call

EXTRACTED = "entities array<struct<name:string,entity_type:string,description:string,confidence:double>>, relationships array<struct<source:string,target:string,relation:string,weight:double>>"


def _asked(rows: DataFrame, prompt: Column, task: str, client: Task | None) -> DataFrame:
    return call(rows.withColumn("_prompt", prompt), "_prompt", "_reply", task, client).drop("_prompt")


def _score(reply: Column, fallback: float) -> Column:
    """The first number of a reply, cut to 0..1; the fallback without one."""
    found = F.regexp_extract(reply, r"\d+(?:\.\d+)?", 0).try_cast("double")
    return F.when(found.isNull(), fallback).otherwise(F.least(F.greatest(found, F.lit(0.0)), F.lit(1.0)))


def widened(queries: DataFrame, client: Task | None = None) -> DataFrame:
    """``expanded`` text of queries (query_id, text): a passage written for them; the query itself where none came."""
    out = _asked(queries, F.col("text"), "expansion", client)
    return out.withColumn("expanded", F.coalesce(F.nullif(F.trim("_reply"), F.lit("")), "text")).drop("_reply")


def condensed(queries: DataFrame, turns: DataFrame, last: int = 6, client: Task | None = None) -> DataFrame:
    """``standalone`` question of (session_id, text) given the last turns (session_id, turn, role, text); without history the question."""
    from quillspark.operators.context import history_window

    joined = queries.join(history_window(turns, last), "session_id", "left")
    prompt = F.when(F.col("history").isNotNull(), F.concat("history", F.lit("\nquestion: "), "text"))
    out = _asked(joined, prompt, "condensation", client)
    return out.withColumn("standalone", F.coalesce(F.nullif(F.trim("_reply"), F.lit("")), "text")).drop("_reply", "history")


def named_entities(queries: DataFrame, client: Task | None = None) -> DataFrame:
    """(query_id, label, pos, text) of the entities of queries (query_id, text); lines that are no ``LABEL: text`` are dropped."""
    lines = _asked(queries.select("query_id", "text"), F.col("text"), "entities", client).select("query_id", F.posexplode(non_empty(F.split("_reply", "\n"))).alias("pos", "line"))
    cut = F.regexp_extract(F.col("line"), r"^([A-Z_]+):\s*(.+)$", 1)
    return lines.where(cut != "").select("query_id", cut.alias("label"), "pos", F.regexp_extract("line", r"^([A-Z_]+):\s*(.+)$", 2).alias("text"))


def extracted_graph(chunks: DataFrame, chars: int = 4000, client: Task | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities (chunk_id, name, entity_type, confidence) and edges (chunk_id, source, target, relation_type, weight) of
    chunks (chunk_id, text); the model sees the first ``chars`` characters, a reply without JSON gives nothing."""
    out = _asked(chunks.select("chunk_id", "text"), F.substring("text", 1, chars), "extraction", client)
    found = out.select("chunk_id", json_object(F.col("_reply"), EXTRACTED).alias("g"))
    entities = found.select("chunk_id", F.inline("g.entities")).where("trim(name) <> ''")
    edges = found.select("chunk_id", F.inline("g.relationships")).where("trim(source) <> '' and trim(target) <> ''")
    return (
        entities.select("chunk_id", F.trim("name").alias("name"), F.coalesce("entity_type", F.lit("UNKNOWN")).alias("entity_type"), F.coalesce("confidence", F.lit(1.0)).alias("confidence")),
        edges.select("chunk_id", "source", "target", F.col("relation").alias("relation_type"), F.coalesce("weight", F.lit(1.0)).alias("weight")),
    )


def conflicts(items: DataFrame, chars: int = 300, client: Task | None = None) -> DataFrame:
    """``conflict`` of each query's context (query_id, rank, text): whether two or more items disagree; false where nothing says so."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.substring("text", 1, chars).alias("t")))), lambda x: x["t"]), "\n---\n")
    asked = items.groupBy("query_id").agg(parts.alias("parts"), F.count("*").alias("n"))
    out = _asked(asked, F.when(F.col("n") >= 2, F.col("parts")), "conflict", client)
    return out.select("query_id", F.coalesce(F.upper(F.trim("_reply")).startswith("YES"), F.lit(False)).alias("conflict"))


def faithfulness(answers: DataFrame, chars: int = 300, client: Task | None = None) -> DataFrame:
    """``faithfulness`` of answers (answer_id, answer, contexts array): grounded claims over claims; 1 without claims, 0.5 where the reply can't be read."""
    context = F.array_join(F.transform("contexts", lambda c: F.substring(c, 1, chars)), "\n")
    out = _asked(answers, F.concat("answer", F.lit("\nCONTEXT:\n"), context), "claims", client)
    claims = json_object(F.col("_reply"), "claims array<struct<claim:string,grounded:boolean>>")["claims"]
    grounded = F.size(F.filter(claims, lambda c: F.coalesce(c["grounded"], F.lit(False))))
    return out.withColumn("faithfulness", F.when(claims.isNull(), 0.5).when(F.size(claims) == 0, 1.0).otherwise(grounded / F.size(claims))).drop("_reply")


def self_consistency(answers: DataFrame, samples: int = 5, client: Task | None = None) -> DataFrame:
    """``consistency`` of answers (answer_id, answer): the mean of ``samples`` judgements; one that can't be read counts 0.5."""
    drawn = answers.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    scored = _asked(drawn, F.concat_ws(" ", "answer", F.lit("sample"), F.col("sample").cast("string")), "judgement", client)
    return scored.groupBy("answer_id").agg(F.avg(_score(F.col("_reply"), 0.5)).alias("consistency"))


def judged(answers: DataFrame, criteria: list[str], most: int = 5, client: Task | None = None) -> DataFrame:
    """(answer_id, criterion, score) of answers (answer_id, question, answer, contexts): one judgement per criterion, null where none could be read."""
    each = answers.withColumn("criterion", F.explode(F.array(*map(F.lit, criteria))))
    prompt = F.concat_ws("\n", "criterion", "question", "answer", F.array_join(F.slice("contexts", 1, most), "\n"))
    out = _asked(each, prompt, "judgement", client)
    return out.select("answer_id", "criterion", F.when(F.col("_reply").rlike(r"\d"), _score(F.col("_reply"), 0.0)).alias("score"))


def synthetic_questions(chunks: DataFrame, chars: int = 1000, client: Task | None = None) -> DataFrame:
    """(chunk_id, question, answer) pairs written for chunks (chunk_id, text); none where the reply can't be read."""
    out = _asked(chunks.select("chunk_id", "text"), F.substring("text", 1, chars), "questions", client)
    pairs = json_object(F.col("_reply"), "pairs array<struct<question:string,answer:string>>")["pairs"]
    return out.select("chunk_id", F.inline(pairs)).where("trim(question) <> '' and trim(answer) <> ''")


def coherence(chunks: DataFrame, chars: int = 800, client: Task | None = None) -> DataFrame:
    """``coherence`` of chunks (chunk_id, text) between 0 and 1; 0.5 where the reply can't be read."""
    out = _asked(chunks, F.substring("text", 1, chars), "judgement", client)
    return out.withColumn("coherence", _score(F.col("_reply"), 0.5)).drop("_reply")


def counterfactuals(queries: DataFrame, most: int = 4, client: Task | None = None) -> DataFrame:
    """(query_id, pos, variant): the query asked otherwise; none where the reply is empty."""
    out = _asked(queries.select("query_id", "text"), F.col("text"), "variants", client)
    return out.select("query_id", F.posexplode(numbered_lines(F.col("_reply"), most)).alias("pos", "variant"))


def answered_from_history(queries: DataFrame, turns: DataFrame, last: int = 10, client: Task | None = None) -> DataFrame:
    """``history_answer`` of (session_id, text) from the last turns, null where retrieval is needed or there is no history."""
    from quillspark.operators.context import history_window

    joined = queries.join(history_window(turns, last), "session_id", "left")
    prompt = F.when(F.col("history").isNotNull(), F.concat("history", F.lit("\nuser: "), "text"))
    out = _asked(joined, prompt, "history_answer", client)
    needs = F.col("_reply").isNull() | F.contains(F.upper("_reply"), F.lit("NEEDS_RETRIEVAL"))
    return out.withColumn("history_answer", F.when(~needs, F.col("_reply"))).drop("_reply", "history")


def summarised_history(turns: DataFrame, most: int = 14, keep: int = 6, client: Task | None = None) -> DataFrame:
    """Turns (session_id, turn, role, text) with the overflow of long sessions folded into one summary row, at turn -1."""
    from quillspark.operators.context import history_split

    split = history_split(turns, most, keep)
    old = split.where("part = 'overflow'").groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("old"))
    told = _asked(old, F.col("old"), "summary", client).select("session_id", F.lit(-1).cast(turns.schema["turn"].dataType).alias("turn"), F.lit("summary").alias("role"), F.col("_reply").alias("text"))
    return split.where("part = 'recent'").select("session_id", "turn", "role", "text").unionByName(told)


def detected_languages(docs: DataFrame, client: Task | None = None) -> DataFrame:
    """``language`` of texts (text) that are long enough; null for others and where none was recognised."""
    out = _asked(docs, F.when(detectable(F.col("text")), F.col("text")), "language", client)
    return out.withColumn("language", F.nullif(F.col("_reply"), F.lit(""))).drop("_reply")


def image_captions(files: DataFrame, client: Task | None = None) -> DataFrame:
    """An element row (path, pos, category, depth, text, modality) for each image file (path, ...); none without a caption."""
    images = files.where(F.lower(F.substring_index("path", ".", -1)).isin("png", "jpg", "jpeg")).select("path")
    out = _asked(images, F.col("path"), "caption", client).where("trim(_reply) <> ''")
    return out.select("path", F.lit(0).alias("pos"), F.lit("Image").alias("category"), F.lit(None).cast("int").alias("depth"), F.col("_reply").alias("text"), F.lit("image_caption").alias("modality"))


def reconciled_preferences(messages: DataFrame) -> DataFrame:
    """The preference in force after each message (session_id, turn, action, preference): the last set one, unless cleared since."""
    state = F.when(F.col("action") == "set", F.struct(F.lit(True).alias("live"), F.col("preference").alias("p"))).when(F.col("action") == "clear", F.struct(F.lit(False).alias("live"), F.lit(None).cast("string").alias("p")))
    last = F.last(state, ignorenulls=True).over(Window.partitionBy("session_id").orderBy("turn"))
    return messages.withColumn("in_force", last["p"])
