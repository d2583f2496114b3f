"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample and broadcast; every vector is put into its leaf. A query walks the tree
with a priority queue of branches, nearest centre first, and takes leaves until they hold as many vectors as were needed
for sample vectors that lie as far from their leaf's centre, and never fewer than it asks for.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, shuffle_parts, table
from quillspark.llm.vectors import asking, best, matrix, part_of, usable

#: Vectors of the sample that fits the tree (chosen by a hash of their ids, of all rows).
SAMPLE = 20_000
BRANCHES = 12
#: Sample vectors below which a node stays a leaf. Small enough to prune, large enough that a query's list of leaves
#: is short beside the vectors it spares.
LEAF = 160
#: Sample vectors are parted by their distance from their leaf's centre at these shares, counted from the farthest; so many
#: of each part are searched for, and the recall that they reach on average sets what the part needs.
FARTHEST, CALIBRATED, RECALL = (0.002, 0.005, 0.01, 0.02, 0.05, 0.2, 0.5), 60, 0.94
#: Vectors, and queries, of one part of a leaf.
PART = 2000
SEED = 11


class Tree:
    """Hierarchical k-means over unit vectors; leaves are numbered in order."""

    def __init__(self, x: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = SEED) -> None:
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []  # a node's number, or -1 - leaf
        self.leaves = 0
        self._grow(x, branches, leaf, np.random.default_rng(seed))

    def _grow(self, x: np.ndarray, branches: int, leaf: int, rng) -> int:
        if len(x) <= leaf or not np.any(x != x[0]):
            self.leaves += 1
            return -self.leaves
        # no more branches than full leaves need
        centres = x[rng.choice(len(x), min(branches, max(2, -(-len(x) // leaf))), replace=False)]
        for _ in range(12):
            near = np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(1), axis=1)
            used = np.unique(near)
            centres = np.stack([x[near == k].mean(0) for k in used])
        near = np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(1), axis=1)
        used = np.unique(near)
        if len(used) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.centres)
        self.centres.append(centres[used])
        self.children.append([])
        for k in used:
            self.children[node].append(self._grow(x[near == k], branches, leaf, rng))
        return node

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of unit vectors."""
        return self.placed(x)[0]

    def placed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row of unit vectors, and the squared distance from the leaf's centre."""
        out, far = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        stack = [(0, np.arange(len(x)))] if self.centres else []
        while stack:
            node, rows = stack.pop()
            c = self.centres[node]
            score = x[rows] @ c.T - 0.5 * (c * c).sum(1)
            near = np.argmax(score, axis=1)
            for k, child in enumerate(self.children[node]):
                part = rows[near == k]
                if child < 0:
                    out[part] = -1 - child
                    far[part] = 1 - 2 * score[near == k, k]
                elif len(part):
                    stack.append((child, part))
        return out, far

    def visit(self, q: np.ndarray, sizes: np.ndarray, vectors: float) -> list[int]:
        """The first leaves, best bin first, that hold ``vectors`` vectors by their ``sizes``: the queue holds open branches
        by distance to their centres."""
        if not self.centres:
            return [0]
        queue, out, held = [(0.0, 0)], [], 0
        while queue and held < vectors:
            _, node = heapq.heappop(queue)
            if node < 0:
                if sizes[-1 - node]:
                    out.append(-1 - node)
                    held += int(sizes[-1 - node])
                continue
            c = self.centres[node]
            for d, child in zip(((c - q) ** 2).sum(1).tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (d, child))
        return out


def calibrate(tree: Tree, x: np.ndarray, k: int, recall: float = RECALL, queries: int = CALIBRATED) -> tuple[np.ndarray, np.ndarray]:
    """(edges, shares): by squared distance from the leaf's centre, the least share of all vectors with which the nearest
    neighbours of the sample's own vectors are found to ``recall`` on average. Far vectors are calibrated by themselves, as
    what suffices for the many within classes would miss theirs."""
    leaf, far = tree.placed(x)
    sizes = np.bincount(leaf, minlength=max(1, tree.leaves))
    order = np.argsort(-far, kind="stable")
    cuts = np.unique([0, *(int(f * len(x)) for f in FARTHEST), len(x)])
    edges, shares = [], []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        needed = []
        for i in order[a:b][:: max(1, (b - a) // queries)]:
            near = x @ x[i]
            near[i] = -2
            wanted = leaf[np.argsort(-near, kind="stable")[:k]]
            seen = tree.visit(x[i], sizes, len(x))
            reach = dict(zip(seen, np.cumsum(sizes[seen]).tolist(), strict=True))
            needed += [reach[w] / len(x) for w in wanted]
        edges.append(float(far[order[b - 1]]))  # the nearest of this part
        shares.append(float(np.quantile(needed, recall, method="higher")))
    return np.array(edges[::-1]), np.array(shares[::-1])


def share_of(far: np.ndarray, edges: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The share of all vectors to visit for queries at these squared distances; ``edges`` ascend, and each begins a part."""
    return shares[np.clip(np.searchsorted(edges, far, side="right") - 1, 0, len(shares) - 1)]


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.max(np.abs(x), axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _leaves(tree):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            leaf = tree.value.leaf_of(unit(matrix(pdf["v"]))) if len(pdf) else np.empty(0, dtype=np.int64)
            yield pdf.assign(leaf=leaf)

    return run


def _visits(tree, plan, sizes: np.ndarray, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = unit(matrix(pdf["v"]))
                vectors = np.maximum(share_of(tree.value.placed(x)[1], *plan) * sizes.sum(), least)
                yield pd.DataFrame({"query_id": pdf["query_id"], "leaves": [tree.value.visit(q, sizes, n) for q, n in zip(x, vectors.tolist(), strict=True)]})

    return run


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of ``q`` with each row of ``x`` in double precision; equal rows give equal values."""
    return (x * q).sum(1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(1)))


def _nearest(k: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(vectors):
            x, ids = matrix(vectors["v"]), vectors["vec_id"].to_numpy()
            u, uq = unit(x), unit(matrix(queries["v"]))
            for i, (query, v) in enumerate(zip(queries["query_id"].tolist(), matrix(queries["v"]), strict=True)):
                near = u @ uq[i]
                near[ids == query] = -2
                kth = np.partition(near, -k)[-k] if len(near) > k else -1.5
                rows = np.flatnonzero((near >= kth - 1e-9) & (near > -1.5))  # exact measure and ties on these
                score = cosines(v, x[rows])
                for j in np.lexsort((ids[rows], -score))[:k]:
                    out.append((query, int(ids[rows[j]]), float(score[j])))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def neighbours(vectors: DataFrame, queries: Column, k: int, sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest rows by cosine of the rows of ``vectors`` (vec_id, embedding) for which ``queries`` holds.

    Rows (query_id, rank, vec_id, score), nearest first, ties to the smaller vec_id; fewer only where there are fewer
    candidates. All rows are indexed; the sample only fits the tree. Leaves are searched in parts of at most about PART vectors by PART queries, so a
    leaf that holds a third of all rows is spread out. Vectors null, empty, zero or with null or non-finite
    components take no part; of rows that share a vec_id each is a candidate, none for its own id's queries, and the
    smallest vector asks. All vectors must have one length. An empty table gives no rows. Other columns, whatever
    their names, are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors).where(F.exists("v", lambda x: x != 0))
    fitted = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    x = unit(matrix(fitted["v"])) if len(fitted) else np.empty((0, 1))
    tree = Tree(x) if len(x) else None
    if tree is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    plan = calibrate(tree, x, k)
    shared = spark.sparkContext.broadcast(tree)
    kind = rows.schema["v"].dataType.simpleString()
    placed = materialize(rows.mapInPandas(_leaves(shared), f"vec_id long, v {kind}, leaf long"), "leaves")
    # a row per leaf, and the leaves are bounded by the sample
    sizes = np.zeros(max(1, tree.leaves), dtype=np.int64)
    for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        sizes[r["leaf"]] = r["n"]
    # as many as are asked for must be left when those of the query's own id are taken off
    own = placed.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    # the walk through the tree is spread over the cluster; only numbers come out of it
    vectors_asked = materialize(asking(rows, queries, "v").repartition(shuffle_parts(spark), "query_id"), "asked")
    visits = vectors_asked.mapInPandas(_visits(shared, plan, sizes, k + own), "query_id long, leaves array<long>")
    asked = materialize(visits.select("query_id", F.explode("leaves").alias("leaf")), "visits")
    # how many parts each leaf has: a row per leaf, and the leaves are bounded by the sample
    vparts = placed.groupBy("leaf").agg(F.ceil(F.count("*") / PART).cast("int").alias("vparts"))
    qparts = asked.groupBy("leaf").agg(F.ceil(F.count("*") / PART).cast("int").alias("qparts"))
    parts = F.broadcast(materialize(vparts.join(qparts, "leaf"), "parts"))
    right = placed.join(parts, "leaf").withColumn("vpart", part_of(F.col("vec_id"), F.col("vparts")))
    right = right.withColumn("qpart", F.explode(F.sequence(F.lit(0), F.col("qparts") - 1)))
    left = asked.join(parts, "leaf").withColumn("qpart", part_of(F.col("query_id"), F.col("qparts")))
    left = left.withColumn("vpart", F.explode(F.sequence(F.lit(0), F.col("vparts") - 1)))
    key = ["leaf", "vpart", "qpart"]
    # a query's vector joins its visits last, and travels as it came
    left, right = left.select("query_id", *key).join(vectors_asked, "query_id"), right.select("vec_id", "v", *key)
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_nearest(k), "query_id long, vec_id long, score double")
    return best(found, k)


def op7_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found of every 50th ``embeddings`` row. Cases as in ``neighbours``."""
    return neighbours(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5)
