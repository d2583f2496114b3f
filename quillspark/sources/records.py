"""JSON records: feedback, golden sets, ledgers and training sets; tables with keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FEEDBACK = "query_id string, timestamp string, question string, answer string, rating string, comment string, session_id string, namespace string, _corrupt_record string"
GOLDEN_QUERY = "query string, relevant_chunk_ids array<string>, expected_answer_keywords array<string>, namespace string, metadata map<string,string>"
GOLDEN_CONVERSATION = (
    "conversation_id string, namespace string, metadata map<string,string>, turns array<struct<query:string,"
    "expected_answer_keywords:array<string>,relevant_chunk_ids:array<string>,expects_condensation:boolean,"
    "condensation_must_contain:array<string>,condensation_must_not_contain:array<string>>>"
)
FAIRNESS_PAIR = (
    "pair_id string, dimension string, namespace string, topic string, metadata map<string,string>, "
    "shared_relevant_chunk_ids array<string>, variants array<struct<label:string,descriptor:string,query:string>>"
)


def feedback(spark: SparkSession, root: str) -> DataFrame:
    """Feedback records of all ``*.jsonl`` and ``*.json`` (an object or a list) below ``root``.

    Broken lines and records without a question or an answer are left out; a missing rating is ``unknown``.
    """
    read = spark.read.schema(FEEDBACK).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", True)
    lines = read.option("pathGlobFilter", "*.jsonl").json(root)
    whole = read.option("pathGlobFilter", "*.json").option("multiLine", True).json(root)
    kept = lines.unionByName(whole).where("_corrupt_record is null and trim(question) <> '' and answer is not null")
    return kept.drop("_corrupt_record").withColumn("rating", F.coalesce("rating", F.lit("unknown")))


def golden(spark: SparkSession, path: str, schema: str = GOLDEN_QUERY) -> DataFrame:
    """A golden set (a JSON list); the namespace defaults to ``default`` and lists to empty ones."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    empty = {f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType)) for f in rows.schema.fields if f.dataType.typeName() == "array"}
    return rows.withColumns(empty | {"namespace": F.coalesce("namespace", F.lit("default"))})


def append_ledger(report: DataFrame, path: str, kind: str) -> None:
    """Append a report to the ledger; its kind parts the files."""
    report.withColumn("report_type", F.lit(kind)).write.mode("append").partitionBy("report_type").json(path)


def ledger(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Reports of one kind; only that kind's folder is read, for its schema too."""
    return spark.read.json(f"{path}/report_type={kind}").withColumn("report_type", F.lit(kind))


def training_set(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict read of a training set: a missing file or an empty set is an error, blank lines are skipped."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if rows.isEmpty():
        raise ValueError(f"no training rows in {path}")
    return rows


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def route_feedback(rows: DataFrame, path: str) -> None:
    """Write feedback by rating, one folder each."""
    rows.write.mode("append").partitionBy("rating").json(path)


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], seq: Column) -> DataFrame:
    """Rows of both by key; the latest by ``seq`` wins, an update over a base row of equal seq."""
    both = base.withColumn("_side", F.lit(0)).unionByName(updates.withColumn("_side", F.lit(1)))
    latest = Window.partitionBy(*keys).orderBy(seq.desc(), F.desc("_side"))
    return both.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "_side")


def cache_rows(rows: DataFrame, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """Rows of a cache with the time at which they expire."""
    return rows.withColumns({"cached_at": now, "expires_at": now + F.make_dt_interval(secs=F.lit(float(ttl_seconds)))})


def stamped(rows: DataFrame, file_name: Column, fallback: Column, now: Column | None = None) -> DataFrame:
    """``rows`` with the time of their ingestion and the version that their file's name gives, else the fallback."""
    from quillspark.functions.text import version_of

    return rows.withColumns({"ingestion_ts": F.current_timestamp() if now is None else now, "doc_version": version_of(file_name, fallback)})


def write_index(chunks: DataFrame, path: str) -> None:
    """Write the postings of the paragraphs of ``chunks`` (namespace, level, chunk_id, text), a folder per namespace."""
    from quillspark.functions.text import terms

    rows = chunks.where("level = 'paragraph'").select("namespace", "chunk_id", terms(F.col("text")).alias("t"))
    each = rows.select("namespace", "chunk_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    posted = each.groupBy("namespace", "term", "chunk_id", "dl").agg(F.count("*").alias("tf"))
    posted.sortWithinPartitions("namespace", "term").write.mode("append").partitionBy("namespace").parquet(path)


def route_unanswered(rows: DataFrame, path: str, least: float = 0.3) -> None:
    """Append the queries whose answers (query, answer, faithfulness, ...) say nothing to the file of unanswerable ones."""
    from quillspark.functions.predicates import unanswered

    rows.where(unanswered(F.col("answer"), F.col("faithfulness"), least)).write.mode("append").json(path)


def write_preferences(rows: DataFrame, path: str) -> None:
    """Append preferences (namespace, ...) in a folder per namespace, named by letters a file name may have."""
    from quillspark.functions.text import file_slug

    rows.withColumn("slug", file_slug(F.col("namespace"))).write.mode("append").partitionBy("slug").json(path)


def sanitised(rows: DataFrame) -> DataFrame:
    """``rows`` with scalar columns only: arrays, maps and structs as JSON, everything else that is no string, number or boolean as text."""

    def plain(field) -> Column:
        kind = field.dataType.typeName()
        if kind in ("array", "map", "struct"):
            return F.to_json(field.name).alias(field.name)
        keeps = kind in ("string", "boolean", "byte", "short", "integer", "long", "float", "double") or kind.startswith("decimal")
        return F.col(field.name) if keeps else F.col(field.name).cast("string").alias(field.name)

    return rows.select(*[plain(f) for f in rows.schema.fields])


def line_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, lines) of the text files that have lines."""
    return spark.read.text(paths).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("lines"))


def setting(config: dict, path: str, default=None):
    """The value at a dotted path of nested dictionaries, or the default."""
    for key in path.split("."):
        if not isinstance(config, dict) or key not in config:
            return default
        config = config[key]
    return config
