"""The SQL surface: table functions that parse and chunk, and the scalar functions, for ``spark.sql``."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, Row, StringType, StructField, StructType

from quillspark.sources.files import page_elements

#: White space as the engine's patterns mean it.
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")

#: Scalars as SQL expressions: Catalyst puts them in place, so nothing leaves the JVM. {name: (parameters, type, body)}
SCALARS = {
    "normalized": ("t STRING", "STRING", "trim(regexp_replace(lower(t), '(?U)\\\\s+', ' '))"),
    "search_terms": ("t STRING", "ARRAY<STRING>", "filter(split(lower(t), '[^\\\\p{L}\\\\p{N}]+'), x -> x <> '')"),
    "text_words": ("t STRING", "ARRAY<STRING>", "filter(split(t, '\\\\s+'), x -> x <> '')"),
    "char_grams": ("t STRING, k INT", "ARRAY<STRING>", "CASE WHEN length(t) < k THEN array() ELSE transform(sequence(1, length(t) - k + 1), i -> substring(t, i, k)) END"),
    "jaccard": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(array_union(a, b)) = 0 THEN 1.0D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END"),
    "cosine": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        "coalesce(aggregate(zip_with(a, b, (x, y) -> x * y), 0.0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0.0D, (s, x) -> s + x * x) * aggregate(b, 0.0D, (s, x) -> s + x * x)), 0.0D), 0.0D)",
    ),
    "rrf_part": ("position INT, k INT", "DOUBLE", "1.0D / (k + position)"),
    "length_reward": ("n INT", "DOUBLE", "CASE WHEN n <= 256 THEN n / 256 WHEN n >= 512 THEN 0.0D ELSE 1 - (n - 256) / 256 END"),
}


def _column(argument: AnalyzeArgument, name: str):
    found = [f for f in argument.dataType.fields if f.name == name]
    if not found:
        raise ValueError(f"the table needs a column {name}; it has {', '.join(f.name for f in argument.dataType.fields)}")
    return found[0].dataType


def _analyzed(rows: AnalyzeArgument, key: str, *out: StructField) -> AnalyzeResult:
    if not rows.isTable:
        raise ValueError("the first argument must be TABLE(...)")
    _column(rows, "text")
    return AnalyzeResult(StructType([StructField(key, _column(rows, key)), *out]))


@udtf
class WordWindows:
    """``word_windows(TABLE(docs) PARTITION BY (doc_id), size, overlap, least)``: the windows of ``chunk.fixed_windows``; the
    id keeps its type."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument, least: AnalyzeArgument) -> AnalyzeResult:
        if size.value is not None and overlap.value is not None and not 0 <= overlap.value < size.value:
            raise ValueError("overlap must be 0 or more and below size")
        return _analyzed(rows, "doc_id", StructField("start", IntegerType()), StructField("n_tokens", IntegerType()), StructField("text", StringType()))

    def eval(self, row: Row, size: int, overlap: int, least: int) -> Iterator[tuple]:
        words = [w for w in _SPACE.split(row["text"] or "") if w]
        for start in range(0, len(words), size - overlap):
            n = min(size, len(words) - start)
            if n >= least or start + size >= len(words):
                yield row["doc_id"], start, n, " ".join(words[start : start + n])


@udtf
class HtmlElements:
    """``html_elements(TABLE(pages) PARTITION BY (doc_id))`` of (doc_id, text): the elements of ``files.html_elements``."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        fields = (StructField("pos", IntegerType()), StructField("category", StringType()), StructField("depth", IntegerType()), StructField("text", StringType()))
        return _analyzed(rows, "doc_id", *fields)

    def eval(self, row: Row) -> Iterator[tuple]:
        for pos, element in enumerate(page_elements(row["text"] or "")):
            yield row["doc_id"], pos, *element


def register(spark: SparkSession) -> None:
    """Make the functions known to ``spark.sql`` in this session."""
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("word_windows", WordWindows)
    spark.udtf.register("html_elements", HtmlElements)
