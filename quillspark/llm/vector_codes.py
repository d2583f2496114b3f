"""Product codes of vectors: a codebook per part position, fitted in whole numbers, searched through a ball tree.

Each round deals the codebooks to all tasks, which assign their rows and return a sum per entry; the driver holds the
codebooks and nothing else. The nearest entry is found by branch and bound over a tree of balls around entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a leaf of the tree.
LEAF = 16
#: Magnitude below which components must lie, so that no distance leaves 64 bits.
LARGEST = 1 << 26
#: Rows that walk through a tree together.
BLOCK = 8192
#: Parts over which the rows of one label are spread.
SPREAD = 32


class BallTree:
    """The entries of one part position, for exact nearest-entry search by the squared Euclidean distance.

    A node is a ball: its vantage entry and the greatest distance from it to the node's entries, rounded up. A query's
    distances are rounded down, and a ball is entered also when its bound equals the best distance yet, so no nearest
    entry and no tie is missed; what decides are integer distances, ties to the lower index.
    """

    def __init__(self, entries: np.ndarray, leaf: int = LEAF) -> None:
        self.entries = entries
        self.vantage: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []  # none for a leaf
        self.members: list[np.ndarray] = []
        self._grow(np.arange(len(entries)), leaf)

    def _grow(self, rows: np.ndarray, leaf: int) -> int:
        node = len(self.vantage)
        x = self.entries[rows]
        # the entry nearest the mean; integer sums, so that each task builds the same tree
        middle = x.sum(0) // len(rows)
        vantage = rows[np.argmin(((x - middle) ** 2).sum(1))]
        d = ((x - self.entries[vantage]) ** 2).sum(1)
        self.vantage.append(int(vantage))
        self.radius.append(_up(int(d.max())))
        self.children.append([])
        self.members.append(rows)
        if len(rows) > leaf and d.max() > 0:
            # two poles far apart share out the entries
            one = rows[np.argmax(d)]
            d1 = ((x - self.entries[one]) ** 2).sum(1)
            d2 = ((x - self.entries[rows[np.argmax(d1)]]) ** 2).sum(1)
            nearer = d1 < d2
            self.members[node] = np.empty(0, dtype=np.int64)
            self.children[node] = [self._grow(rows[nearer], leaf), self._grow(rows[~nearer], leaf)]
        return node

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row of ``q``; integers."""
        self._q, self._squares = q, (q * q).sum(1)
        largest = max(int(np.abs(q).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        # products in floating point where no sum can be rounded
        self._exact = 4 * largest * largest * max(1, q.shape[1]) < 1 << 52
        self._best = np.full(len(q), np.iinfo(np.int64).max)
        self._index = np.full(len(q), len(self.entries))
        #: Distances computed, for the share that the tree spares.
        self.tested = 0
        if len(q):
            self._visit(0, np.arange(len(q)))
        return self._index, self._best

    def _to(self, entry: int, rows: np.ndarray) -> np.ndarray:
        return ((self._q[rows] - self.entries[entry]) ** 2).sum(1)

    def _between(self, rows: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Squared distances of the rows from entries, integers."""
        x = self.entries[members]
        if not self._exact:
            return ((self._q[rows][:, None] - x[None]) ** 2).sum(2)
        products = (self._q[rows].astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
        return self._squares[rows][:, None] + (x * x).sum(1) - 2 * products

    def _visit(self, node: int, rows: np.ndarray) -> None:
        """Search a node for ``rows``, all of which may have their nearest entry there."""
        if not self.children[node]:
            members = self.members[node]
            d = self._between(rows, members)
            self.tested += d.size
            at = d.argmin(1)  # members ascend, so ties go to the lower index
            d, e = d[np.arange(len(rows)), at], members[at]
            better = (d < self._best[rows]) | ((d == self._best[rows]) & (e < self._index[rows]))
            self._best[rows[better]], self._index[rows[better]] = d[better], e[better]
            return
        a, b = self.children[node]
        fars = [_down(self._to(self.vantage[c], rows)) for c in (a, b)]
        self.tested += 2 * len(rows)
        bounds = [np.maximum(fars[0] - self.radius[a], 0), np.maximum(fars[1] - self.radius[b], 0)]
        a_first = fars[0] <= fars[1]
        # the nearer ball first; the other one only where it may hold an entry as near as the best
        for first, second, turn in ((0, 1, a_first), (1, 0, ~a_first)):
            for side in (first, second):
                live = np.flatnonzero(turn)
                live = live[bounds[side][live] <= _up(self._best[rows[live]])]
                if len(live):
                    self._visit((a, b)[side], rows[live])


def _up(squared):
    """An upper bound of the root."""
    return np.sqrt(np.asarray(squared, dtype=np.float64)) * (1 + 1e-12)


def _down(squared):
    """A lower bound of the root."""
    return np.sqrt(np.asarray(squared, dtype=np.float64)) * (1 - 1e-12)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), -1)


def assigned(q: np.ndarray, trees: list[BallTree]) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, squared distances), a column per part position, of the nearest entries of the rows of ``q``."""
    width = q.shape[1] // len(trees)
    index, far = np.empty((len(q), len(trees)), dtype=np.int64), np.empty((len(q), len(trees)), dtype=np.int64)
    for p, tree in enumerate(trees):
        x = np.ascontiguousarray(q[:, p * width : (p + 1) * width])
        for a in range(0, len(q), BLOCK):
            index[a : a + BLOCK, p], far[a : a + BLOCK, p] = tree.nearest(x[a : a + BLOCK])
    return index, far


def _sums(books):
    """A row per part position and entry that a task's rows use: how many, and the sum of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [BallTree(b) for b in books.value]
        n = np.zeros((len(trees), len(trees[0].entries)), dtype=np.int64)
        total = np.zeros((*n.shape, trees[0].entries.shape[1]), dtype=np.int64)
        for batch in batches:
            if not len(batch):
                continue
            q = _matrix(batch.column("q"))
            index, _ = assigned(q, trees)
            for p in range(len(trees)):
                np.add.at(n[p], index[:, p], 1)
                np.add.at(total[p], index[:, p], q[:, p * total.shape[2] : (p + 1) * total.shape[2]])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": n[part, entry], "sums": pa.array(list(total[part, entry]), pa.list_(pa.int64()))}
        )

    return run


def _coded(books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [BallTree(b) for b in books.value]
        for batch in batches:
            q = _matrix(batch.column("q")) if len(batch) else np.empty((0, len(trees)), dtype=np.int64)
            index, far = assigned(q, trees)
            codes = [bytes(row).hex() for row in index.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(far.sum(1))], names=["vec_id", "label", "code", "error"])

    return run


def integers(vectors: DataFrame, parts: int, scale: int) -> DataFrame:
    """(vec_id, label, q): the rows whose vector has finite components only, as integers floor(scale * x)."""
    finite = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).where(finite)
    small = lambda y: F.when(F.abs(y) < LARGEST, y.cast("int")).otherwise(F.raise_error(F.lit(f"components must lie within {LARGEST} / {scale}")).cast("int"))
    whole = rows.select("vec_id", "label", F.transform("v", lambda x: small(F.floor(F.lit(float(scale)) * x))).alias("q"))
    whole = materialize(whole, "integers")
    longest = whole.agg(F.max(F.size("q"))).first()[0] or 0
    width = max(parts, -(-longest // parts) * parts)
    padded = F.concat("q", F.array_repeat(F.lit(0), F.lit(width) - F.size("q")))
    return whole.withColumn("q", padded)


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) of ``rows`` (vec_id, q): begun with the ``entries`` smallest vec_ids, then
    ``rounds`` times each entry becomes the floored mean of the parts nearest to it; unused ones stay."""
    spark = rows.sparkSession
    begin = rows.orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).select("q").collect()
    books = np.array([r["q"] for r in begin], dtype=np.int64).reshape(len(begin), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(np.ascontiguousarray(books))
        summed = rows.select("q").mapInArrow(_sums(shared), "part int, entry int, n long, sums array<long>")
        columns = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(books.shape[2])]
        books = books.copy()
        for r in summed.groupBy("part", "entry").agg(F.sum("n").alias("n"), *columns).collect():  # a row per entry at most
            books[r["part"], r["entry"]] = [s // r["n"] for s in r[3:]]
        shared.unpersist()
    return np.ascontiguousarray(books)


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Product codes of ``vectors`` (vec_id, embedding, label): (vec_id, code, error, label_error, codebooks_sha256).

    Components become floor(scale * x); vectors are cut into ``parts`` equal parts, each coded by its nearest codebook
    entry (two hex digits; ``entries`` is 256 at most). ``error`` sums a row's squared distances, ``label_error`` the
    errors of all rows of its label, null labels together. Vectors null or with null or non-finite components are left
    out. Rows that share a vec_id, or have none, are rows of their own; begun with are the smallest ids, ids that are
    null last, then the smaller vector; with fewer rows there are fewer entries. Vectors shorter than the longest, or
    whose length isn't a multiple of ``parts``, count as followed by zeros. An empty table gives no rows. Components
    of 2**26 / scale or more are an error. Other columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, parts, scale)
    kinds = [vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    schema = f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long"
    if rows.isEmpty():
        return spark.createDataFrame([], schema.replace("label", "_l", 1) + ", label_error long, codebooks_sha256 string").drop("_l")
    books = fit(rows, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = materialize(rows.mapInArrow(_coded(spark.sparkContext.broadcast(books)), schema), "codes")
    # a label may hold a third of the rows: they are spread, and the labels' sums go to every part
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    sums = sums.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    dealt = coded.withColumn("part", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SPREAD)).cast("int"))
    joined = dealt.join(sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("part") == F.col("_part")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all ``embeddings``. Cases as in ``vector_codes``."""
    return vector_codes(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op11_sql() -> str:
    """Equal result in SQL for vectors of one length; every entry is compared."""
    near = lambda n: f"""
near{n} AS (
  SELECT r, part, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT p.r, p.part, b.e, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.c[i]) * (p.x[i] - b.c[i])))::BIGINT AS d
    FROM parts p JOIN book{n} b ON p.part = b.part) GROUP BY r, part),"""  # noqa: E731
    step = lambda n: f"""
mean{n} AS (
  SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS c FROM (
    SELECT part, e, i, sum(v)::BIGINT AS s, count(*) AS n FROM (
      SELECT p.part, a.e, unnest(p.x) AS v, unnest(range(len(p.x))) AS i FROM parts p JOIN near{n} a ON p.r = a.r AND p.part = a.part) GROUP BY ALL)
  GROUP BY part, e),
book{n + 1} AS (SELECT b.part, b.e, coalesce(m.c, b.c) AS c FROM book{n} b LEFT JOIN mean{n} m ON b.part = m.part AND b.e = m.e),"""  # noqa: E731
    rounds = "".join(near(n) + step(n) for n in range(ROUNDS))
    return f"""
WITH ok AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, part, q[part * len(q) // {PARTS} + 1:(part + 1) * len(q) // {PARTS}] AS x FROM ok, range({PARTS}) t(part)),
book0 AS (
  SELECT p.part, o.e, p.x AS c FROM parts p
  JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS e FROM ok QUALIFY e < {ENTRIES}) o ON p.r = o.r),{rounds}{near(ROUNDS)}
coded AS (SELECT r, string_agg(printf('%02x', e::INTEGER), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY r),
digest AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, e, i)) AS codebooks_sha256 FROM (SELECT part, e, unnest(c) AS v, unnest(range(len(c))) AS i FROM book{ROUNDS}))
SELECT o.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY o.label)::BIGINT AS label_error, g.codebooks_sha256
FROM ok o JOIN coded c ON o.r = c.r, digest g
"""
