"""Knowledge-graph operators: merges, traversal, components, communities and graph search."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import capital_words, capitalised, edge_id, entity_id
from quillspark.tables import bounded_batches, staged


def mentions(chunks: DataFrame) -> DataFrame:
    """(chunk_id, node_id, name) of the capitalised words of ``chunks`` (chunk_id, text)."""
    named = chunks.select("chunk_id", F.explode(F.array_distinct(F.transform(capital_words(F.col("text")), F.lower))).alias("name"))
    return named.select("chunk_id", entity_id(F.lit("TERM"), F.col("name")).alias("node_id"), "name")


def merge_entities(rows: DataFrame) -> DataFrame:
    """Entities of (node_id, name, entity_type, description, confidence, chunk_id, seq) by node: the last write of each field, chunks in order."""
    last = lambda c: F.max_by(c, "seq").alias(c)
    chunks = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk_id"))), lambda x: x["chunk_id"]))
    return rows.groupBy("node_id").agg(last("name"), last("entity_type"), last("description"), last("confidence"), chunks.alias("source_chunks"), F.min("seq").alias("created"), F.max("seq").alias("updated"))


def merge_edges(rows: DataFrame) -> DataFrame:
    """Edges of (source_id, relation_type, target_id, weight, chunk_id): the weights of all chunks summed, repeats in a chunk
    included."""
    out = chunk_edges(rows).groupBy("source_id", "relation_type", "target_id").agg(F.sum("weight").alias("weight"), F.array_sort(F.collect_set("chunk_id")).alias("source_chunks"))
    return out.withColumn("edge_id", edge_id(F.col("source_id"), F.col("relation_type"), F.col("target_id")))


def chunk_edges(rows: DataFrame) -> DataFrame:
    """Edges of (chunk_id, source_id, relation_type, target_id, weight) once per chunk, with the weights of repeats summed."""
    return rows.groupBy("chunk_id", "source_id", "relation_type", "target_id").agg(F.sum("weight").alias("weight"))


def resolve_endpoints(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges (chunk_id, source, target, ...) whose two names are both entities (chunk_id, name, node_id) of the same chunk."""
    known = entities.select("chunk_id", F.lower(F.trim("name")).alias("k"), "node_id").distinct()
    side = lambda name, out: known.select("chunk_id", F.col("k").alias(name), F.col("node_id").alias(out))
    rows = edges.withColumns({"_s": F.lower(F.trim("source")), "_t": F.lower(F.trim("target"))})
    return rows.join(side("_s", "source_id"), ["chunk_id", "_s"]).join(side("_t", "target_id"), ["chunk_id", "_t"]).drop("_s", "_t")


def labelled(rows: DataFrame, column: str, registry: DataFrame, other: str) -> DataFrame:
    """``column`` upper-cased where the registry (label) has it, else ``other``."""
    known = registry.select(F.upper("label").alias("_label")).distinct()
    joined = rows.withColumn("_k", F.upper(F.trim(column))).join(known, F.col("_k") == F.col("_label"), "left")
    return joined.withColumn(column, F.coalesce("_label", F.lit(other))).drop("_k", "_label")


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight) with a < b: weights summed over both directions and all relations."""
    return edges.where("source_id <> target_id").groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.sum("weight").alias("weight"))


def resolve_names(names: DataFrame, entities: DataFrame) -> DataFrame:
    """The node of each exact name of ``names`` (query_id, name); of several the smallest node_id."""
    one = entities.groupBy("name").agg(F.min("node_id").alias("node_id"))
    return names.join(one, "name")


def neighbours(starts: DataFrame, edges: DataFrame, hops: int = 2, relation: str | None = None, both_ways: bool = False, most: int | None = None) -> DataFrame:
    """(start, node, depth) of the nodes within ``hops`` of ``starts`` (start), each at its least depth; the start is none.

    Only edges of the ``relation`` count, if one is given, and ``most`` nodes of a start stay, by depth and then by name.
    """
    used = edges if relation is None else edges.where(F.col("relation_type") == relation)
    steps = used.select(F.col("source_id").alias("node"), F.col("target_id").alias("next"))
    if both_ways:
        steps = steps.union(steps.select(F.col("next").alias("node"), F.col("node").alias("next")))
    steps = steps.distinct()
    front = starts.select("start", F.col("start").alias("node")).distinct()
    reached = front.withColumn("depth", F.lit(0))
    for depth in range(1, hops + 1):
        found = front.join(steps, "node").select("start", F.col("next").alias("node")).distinct()
        front = found.join(reached.select("start", "node"), ["start", "node"], "left_anti")
        reached = reached.union(front.withColumn("depth", F.lit(depth)))
    reached = reached.where("depth > 0")
    return reached if most is None else ordered_limit(reached, "start", most, "depth", "node")


def induced(starts: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """Edges whose two ends lie within ``hops`` of a start, in either direction: (start, source_id, target_id)."""
    near = neighbours(starts, edges, hops, both_ways=True).select("start", "node").union(starts.select("start", F.col("start").alias("node")))
    ends = edges.select("source_id", "target_id").distinct()
    return ends.join(near.withColumnRenamed("node", "source_id"), "source_id").join(near.withColumnRenamed("node", "target_id"), ["start", "target_id"]).select("start", "source_id", "target_id").distinct()


def _dealt(side: DataFrame) -> DataFrame:
    """A side of a join that holds rows by node: shuffled, never sent through the driver, as it grows with the graph and is
    joined many times."""
    return side.hint("merge")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) lead to, by label propagation with pointer jumping."""
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = staged(nodes.select("node").distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(_dealt(labels.withColumnRenamed("node", "b")), "b").groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(_dealt(near.withColumnRenamed("a", "node")), "node", "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("old"))
        roots = lower.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = lower.join(_dealt(roots), "component", "left").select("node", F.least("component", F.coalesce("root", "component")).alias("component"), "old")
        jumped = staged(jumped)
        labels = jumped.select("node", "component")
        if jumped.where("component <> old").isEmpty():
            return labels


def modularity(labels: DataFrame, edges: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of ``labels`` (node, community) over ``edges`` (a, b, weight), each edge given once."""
    a, b = labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), labels.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    both = edges.join(_dealt(a), "a").join(_dealt(b), "b")
    inside = both.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("own")).first()
    if not inside["m"]:
        return 0.0
    ends = both.select(F.col("ca").alias("c"), "weight").union(both.select("cb", "weight"))
    spread = ends.groupBy("c").agg(F.sum("weight").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("s")).first()["s"]
    return inside["own"] / inside["m"] - resolution * spread / (2 * inside["m"]) ** 2


def local_moves(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(node, community) by greedy moves that raise the modularity, all nodes of a hash class at a time.

    ``edges``: (a, b, weight), a node's edge to itself its inner weight. In each turn the nodes of one of two hash classes may move to the label with the highest
    weight to them less ``resolution`` * degree * label degree / (2 * total weight), their own degree left out; ties to
    one label by its hash. Turns go on until a pair of them has not raised the modularity (simultaneous moves may lower
    it), and the best labels seen are the result. A local optimum, not the greatest modularity.
    """
    both = staged(edges.select("a", "b", "weight").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    degree = staged(both.groupBy("a").agg(F.sum("weight").alias("degree")))
    other = both.where("a <> b")  # what a node holds itself pulls it nowhere
    total = degree.agg(F.sum("degree")).first()[0] or 1.0
    labels = staged(nodes.select("node").distinct().withColumn("community", F.col("node")))
    best_labels, best, since, turn = labels, modularity(labels, edges, resolution), 0, 0
    while since < 2:
        sized = labels.join(_dealt(degree.withColumnRenamed("a", "node")), "node", "left").fillna({"degree": 0.0})
        mass = sized.groupBy("community").agg(F.sum("degree").alias("mass"))
        pull = other.join(_dealt(labels.withColumnRenamed("node", "b")), "b").groupBy("a", "community").agg(F.sum("weight").alias("w"))
        pull = pull.join(_dealt(mass), "community").join(_dealt(degree), "a").join(_dealt(labels.select(F.col("node").alias("a"), F.col("community").alias("own"))), "a")
        others = F.col("mass") - F.when(F.col("community") == F.col("own"), F.col("degree")).otherwise(0.0)
        gain = F.round(F.col("w") - resolution * F.col("degree") * others / total, 9)
        choice = pull.groupBy("a").agg(F.max(F.struct(gain.alias("g"), (-F.hash("community")).alias("h"), F.col("community").alias("c"))).alias("x"))
        moved = labels.join(_dealt(choice.select(F.col("a").alias("node"), "x.c", "x.g")), "node", "left")
        mine = F.pmod(F.hash("node"), F.lit(2)) == turn % 2
        moved = staged(moved.select("node", F.when(mine & (F.col("g") > 0), F.col("c")).otherwise(F.col("community")).alias("community"), F.col("community").alias("old")))
        labels, turn = moved.select("node", "community"), turn + 1
        now = modularity(labels, edges, resolution)
        since = 0 if now > best + 1e-9 else since + 1
        if now > best + 1e-9:
            best_labels, best = labels, now
    return best_labels


def connected_parts(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, community) with each community cut into the parts that its own edges (a, b) connect; a part is
    named by its smallest node. The modularity never falls by it."""
    a, b = labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), labels.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    inside = edges.join(_dealt(a), "a").join(_dealt(b), "b").where("ca = cb and a <> b").select("a", "b")
    return components(labels, inside).withColumnRenamed("component", "community")


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(node, community) by levels of greedy moves: (a, b, weight) ``edges``, each given once.

    The nodes move as in ``local_moves``, communities are cut to connected parts, and the parts become the nodes of a
    smaller graph, whose edges sum theirs, and move again, until the modularity stops rising. Every community is
    connected, and the modularity no lower than after the moves of the first level.
    """
    labels = staged(nodes.select("node").distinct().withColumn("community", F.col("node")), "labels")
    level_nodes, level_edges, best = labels.select("node"), staged(edges.select("a", "b", "weight"), "edges"), modularity(labels, edges, resolution)
    while True:
        parts = staged(connected_parts(local_moves(level_nodes, level_edges, resolution), level_edges), "parts")
        merged = labels.join(_dealt(parts.select(F.col("node").alias("community"), F.col("community").alias("next"))), "community")
        merged = staged(merged.select("node", F.col("next").alias("community")), "labels")
        now = modularity(merged, edges, resolution)
        if now <= best + 1e-9:
            return labels
        labels, best, level_nodes = merged, now, parts.select(F.col("community").alias("node")).distinct()
        a, b = parts.select(F.col("node").alias("a"), F.col("community").alias("ca")), parts.select(F.col("node").alias("b"), F.col("community").alias("cb"))
        ends = level_edges.join(_dealt(a), "a").join(_dealt(b), "b").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "weight")
        level_edges = staged(ends.groupBy("a", "b").agg(F.sum("weight").alias("weight")), "edges")


def levels(nodes: DataFrame, edges: DataFrame, resolutions: tuple[float, ...] = (1.0, 0.5), least: int = 2) -> DataFrame:
    """Communities at several resolutions: (level, community_id, label, members) of those with ``least`` members."""
    from functools import reduce

    from quillspark.functions.text import community_id

    found = [communities(nodes, edges, r).withColumn("level", F.lit(i)) for i, r in enumerate(resolutions)]
    grouped = reduce(DataFrame.unionByName, found).groupBy("level", F.col("community").alias("label")).agg(F.count("*").alias("members"))
    return grouped.where(F.col("members") >= least).withColumn("community_id", community_id(F.col("level"), F.col("label")))


def local_search(queries: DataFrame, entities: DataFrame, edges: DataFrame, mentioned: DataFrame, hops: int = 2, k: int = 10) -> DataFrame:
    """Chunks near the entities that queries (query_id, text) name: (query_id, chunk_id, depth, rank), by depth, then chunk_id.

    A query goes a hop further only while it has fewer than ``k`` hits; so of an entity its 2k - 1 first chunks are enough:
    fewer than k of them can be hits of a lower depth.
    """
    names = queries.select("query_id", F.explode(capitalised(F.col("text"))).alias("name")).withColumn("name", F.lower("name"))
    # by dense rank, as a chunk may be mentioned twice
    first = mentioned.select(F.col("node_id").alias("node"), "chunk_id", F.dense_rank().over(Window.partitionBy("node_id").orderBy("chunk_id")).alias("_n"))
    first = staged(first.where(F.col("_n") < 2 * k).select("node", "chunk_id"))
    steps = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("next"))  # few are joined, so repeats don't matter
    best = Window.partitionBy("query_id").orderBy("depth", "chunk_id")

    def hits(nodes: DataFrame, depth: int, known: DataFrame | None) -> DataFrame:
        found = nodes.join(first, "node").select("query_id", "chunk_id", F.lit(depth).alias("depth"))
        found = (found if known is None else known.union(found)).groupBy("query_id", "chunk_id").agg(F.min("depth").alias("depth"))
        return staged(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"))

    front = reached = staged(resolve_names(names, entities).select("query_id", F.col("node_id").alias("node")).distinct())
    found = hits(front, 0, None)
    for depth in range(1, hops + 1):
        full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
        going = front.join(full, "query_id", "left_anti")
        after = going.join(steps, "node").select("query_id", F.col("next").alias("node")).distinct()
        front = staged(after.join(reached, ["query_id", "node"], "left_anti"))
        reached, found = reached.union(front), hits(front, depth, found)
    return found.withColumn("rank", F.row_number().over(best))


def entity_search(queries: DataFrame, entities: DataFrame, k: int = 10, entity_type: str | None = None) -> DataFrame:
    """The ``k`` entities (node bigint, vector, entity_type) nearest to each query (query_id, vector): (query_id, node, score, rank).

    The type is tested after the search, so a query may keep fewer than ``k``.
    """
    from quillspark.operators.search import dense_topk

    hits = dense_topk(queries, entities.select(F.col("node").alias("chunk_id"), "vector"), k).withColumnRenamed("chunk_id", "node")
    return hits if entity_type is None else hits.join(entities.where(F.col("entity_type") == entity_type).select("node"), "node", "left_semi")


def community_members(members: DataFrame, entities: DataFrame) -> DataFrame:
    """The metadata of the members (level, community, node) of communities: entities joined by node."""
    return members.join(entities, "node")


def hybrid_search(local: DataFrame, communities_found: DataFrame, vector: DataFrame, k: int = 5) -> DataFrame:
    """Reciprocal rank fusion of local hits, community summaries and vector hits (each query_id, key, rank); ties as in ``fuse``."""
    from quillspark.operators.search import fuse

    return fuse([one.select("query_id", F.col("key").alias("chunk_id"), "rank") for one in (local, communities_found, vector)], k).withColumnRenamed("chunk_id", "key")


def global_search(entity_hits: DataFrame, members: DataFrame, summaries: DataFrame) -> DataFrame:
    """Summaries of the communities of entity hits (query_id, node, score): (query_id, community, score, summary)."""
    found = entity_hits.join(members, "node").groupBy("query_id", "community").agg(F.max("score").alias("score"))
    return found.join(summaries, "community")


def _holding(names):
    """Which of the names each text holds, by one pass of an automaton over the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in names.value:
            automaton.add_word(name, name)
        automaton.make_automaton()
        for pdf in batches:
            found = [(i, k) for i, t in zip(pdf["chunk_id"], pdf["t"], strict=True) if t for k in {k for _, k in automaton.iter(t)}]
            yield pd.DataFrame(found, columns=["chunk_id", "k"])

    return run


#: Names that one pass over the texts looks for.
NAMES_A_PASS = 200_000


def entity_coverage(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks whose text holds each wanted name (name) anywhere, even within words, any case: (name, n_chunks, covered).

    The names are broadcast NAMES_A_PASS at a time, with a pass over the texts for each such part. An empty or null name
    is in no chunk.
    """
    spark = chunks.sparkSession
    bounded_batches(spark)
    keyed = wanted.select("name", F.lower("name").alias("k"))
    keys = staged(keyed.where("k <> ''").select("k").distinct())
    parts = -(-keys.count() // NAMES_A_PASS)
    texts = chunks.select("chunk_id", F.lower("text").alias("t"))
    seen = spark.createDataFrame([], "k string, n_chunks long")
    for part in range(parts):
        names = spark.sparkContext.broadcast([r["k"] for r in keys.where(F.pmod(F.xxhash64("k"), F.lit(parts)) == part).collect()])
        found = texts.mapInPandas(_holding(names), f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, k string")
        seen = seen.union(found.groupBy("k").agg(F.count("*").alias("n_chunks")))
    return keyed.join(seen, "k", "left").select("name", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.col("n_chunks").isNotNull().alias("covered"))


def missing_embeddings(entities: DataFrame) -> DataFrame:
    """Text to embed of entities without a vector."""
    return entities.where("embedding is null").select("node_id", F.concat_ws(": ", "name", F.coalesce("description", F.lit(""))).alias("text"))


def ordered_limit(rows: DataFrame, per: str, n: int, *order: str | Column) -> DataFrame:
    """The first ``n`` rows of each group in an explicit order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def level_counts(members: DataFrame, least: int = 2) -> DataFrame:
    """Communities and members by level of (level, label, node), of communities with ``least`` members."""
    sizes = members.groupBy("level", "label").agg(F.count("*").alias("members")).where(F.col("members") >= least)
    return sizes.groupBy("level").agg(F.count("*").alias("n_communities"), F.sum("members").alias("n_members"))


def entity_groups(rows: DataFrame) -> DataFrame:
    """A map from label to the texts found, in order of place, of each query's entities (query_id, label, pos, text)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    by_label = rows.groupBy("query_id", "label").agg(listed.alias("texts"))
    return by_label.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "texts"))).alias("groups"))
