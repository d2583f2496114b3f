"""A data source of JSON records that reports what it can't read: ``spark.read`` and ``spark.readStream`` of the same rows.

    spark.dataSource.register(JsonRecords)
    spark.read.format("json_records").schema(FEEDBACK).option("path", root).load()

A row per line of ``*.jsonl`` files and per object of ``*.json`` files (one object or a list), with the record's fields as
the schema asks for them, its file, its place there, and what is wrong with it, if anything. Files are read through Arrow's
file systems (local folders, hdfs://, s3://, gs://), one partition each; what only Spark can open is ``records.feedback``'s.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, MapType, StringType, StructType

FEEDBACK = "query_id string, timestamp string, question string, answer string, rating string, comment string, session_id string, namespace string"
GOLDEN = "query string, relevant_chunk_ids array<string>, expected_answer_keywords array<string>, namespace string, metadata map<string,string>"
#: What each row has besides its fields.
PLACE = "source_file string, place long, problem string"
#: Bytes read at once when the end of the last whole line is looked for.
_TAIL = 1 << 16


class Part(InputPartition):
    """Bytes ``start`` to ``end`` of a file, to its end if that is None."""

    def __init__(self, path: str, start: int, end: int | None) -> None:
        super().__init__((path, start, end))


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def _files(root: str) -> list[fs.FileInfo]:
    system, path = _opened(root)
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((f for f in found if f.is_file and f.extension in ("jsonl", "json")), key=lambda f: f.path)


def _fitting(value, kind: DataType):
    """``value`` as the type asks for it; a ValueError where it isn't of that kind. Text takes any scalar."""
    if value is None:
        return None
    if isinstance(kind, StringType) and not isinstance(value, dict | list):
        return value if isinstance(value, str) else json.dumps(value)
    if isinstance(kind, BooleanType) and isinstance(value, bool):
        return value
    if isinstance(kind, LongType) and isinstance(value, int) and not isinstance(value, bool):
        return value
    if isinstance(kind, DoubleType) and isinstance(value, int | float) and not isinstance(value, bool):
        return float(value)
    if isinstance(kind, ArrayType) and isinstance(value, list):
        return [_fitting(v, kind.elementType) for v in value]
    if isinstance(kind, MapType) and isinstance(value, dict):
        return {k: _fitting(v, kind.valueType) for k, v in value.items()}
    if isinstance(kind, StructType) and isinstance(value, dict):
        return tuple(_fitting(value.get(f.name), f.dataType) for f in kind.fields)
    raise ValueError(f"{json.dumps(value)[:60]} is no {kind.simpleString()}")


def _row(value, schema: StructType, file: str, place: int, problem: str | None = None) -> tuple:
    """The record as a row; one that doesn't fit has its problem and no fields."""
    fields = schema.fields[:-3]
    if problem is None:
        try:
            if not isinstance(value, dict):
                raise ValueError("not an object")
            return (*(_fitting(value.get(f.name), f.dataType) for f in fields), file, place, None)
        except ValueError as e:
            problem = str(e)
    return (*[None] * len(fields), file, place, problem)


def _rows(root: str, part: Part | None, schema: StructType) -> Iterator[tuple]:
    """Rows of a file's part; ``place`` is the byte at which a line begins, or the number of an object."""
    if part is None:  # what Spark asks for where there is no file
        return
    path, start, end = part.value
    with _opened(root)[0].open_input_file(path) as f:
        f.seek(start)
        data = f.read() if end is None else f.read(end - start)
    if path.endswith(".json"):
        try:
            whole = json.loads(data)
        except ValueError as e:
            yield _row(None, schema, path, 0, f"no JSON: {e}")
            return
        for i, value in enumerate(whole if isinstance(whole, list) else [whole]):
            yield _row(value, schema, path, i)
        return
    at = start
    for line in data.split(b"\n"):
        if line.strip():
            try:
                yield _row(json.loads(line), schema, path, at)
            except ValueError as e:
                yield _row(None, schema, path, at, f"no JSON: {e}")
        at += len(line) + 1


class _Reader(DataSourceReader):
    def __init__(self, root: str, schema: StructType) -> None:
        self.root, self.schema = root, schema

    def partitions(self) -> list[Part]:
        return [Part(f.path, 0, None) for f in _files(self.root)]

    def read(self, partition: Part) -> Iterator[tuple]:
        return _rows(self.root, partition, self.schema)


class _StreamReader(DataSourceStreamReader):
    """The offset is how much of each file has been read: of lines the whole ones, of other files all."""

    def __init__(self, root: str, schema: StructType) -> None:
        self.root, self.schema = root, schema

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f.path: self._whole(f) for f in _files(self.root)}

    def _whole(self, info: fs.FileInfo) -> int:
        if info.extension == "json":
            return info.size
        with _opened(self.root)[0].open_input_file(info.path) as f:
            end = info.size
            while end:
                start = max(0, end - _TAIL)
                f.seek(start)
                if (at := f.read(end - start).rfind(b"\n")) >= 0:
                    return start + at + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(path, 0 if path.endswith(".json") else start.get(path, 0), to) for path, to in sorted(end.items()) if to != start.get(path, 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        return _rows(self.root, partition, self.schema)

    def commit(self, end: dict) -> None:
        pass


class JsonRecords(DataSource):
    """Options: ``path``. The schema given is the fields'; ``PLACE`` is added by ``records``."""

    @classmethod
    def name(cls) -> str:
        return "json_records"

    def schema(self) -> str:
        return f"{FEEDBACK}, {PLACE}"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> _StreamReader:
        return _StreamReader(self.options["path"], schema)


def records(spark: SparkSession, root: str, fields: str = FEEDBACK, stream: bool = False) -> DataFrame:
    """The records below ``root`` with their ``fields`` and ``PLACE``, as a batch or as a stream."""
    spark.dataSource.register(JsonRecords)
    return (spark.readStream if stream else spark.read).format("json_records").schema(f"{fields}, {PLACE}").option("path", root).load()


def checked_feedback(rows: DataFrame) -> DataFrame:
    """Feedback with a missing rating as ``unknown``; a record without a question or an answer has that as its problem."""
    missing = F.when(F.col("question").isNull() | (F.trim("question") == ""), "no question").when(F.col("answer").isNull(), "no answer")
    return rows.withColumns({"rating": F.when(F.col("problem").isNull(), F.coalesce("rating", F.lit("unknown"))), "problem": F.coalesce("problem", missing)})
