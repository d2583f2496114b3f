"""What the vector searches share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows whose vector is not null or empty and has finite components only; v is an array of
    floats as it stands, or else of doubles."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col).cast(kind if kind == "array<float>" else "array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0)).where(finite)


def matrix(column: pd.Series) -> np.ndarray:
    """Vectors of a pandas column as rows."""
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def asking(rows: DataFrame, queries: Column, vector: str) -> DataFrame:
    """(query_id, vector) of the rows for which ``queries`` holds; of rows that share an id the smallest vector asks."""
    return rows.where(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(vector).alias(vector))


def part_of(id_: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(id_), parts).cast("int")


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows (query_id, vec_id, score) of each query, ties to the smaller vec_id, with rank int."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
