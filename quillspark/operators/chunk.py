"""Chunking: heading stacks, fixed windows, sentence windows and semantic segments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.metrics import cosine
from quillspark.functions.text import sentences, sha, token_count, words

DEPTHS = 6


def heading_stack(elements: DataFrame) -> DataFrame:
    """``section`` and ``breadcrumb`` of each element of (doc_id, pos, category, depth, text).

    A heading replaces all at its depth or deeper. Of depth d the last heading before an element is alive when no
    shallower one came after it. A title itself carries the state before it.
    """
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    title = F.col("category") == "Title"
    last = {d: F.max(F.when(title & (F.col("depth") == d), F.struct("pos", "text"))).over(before) for d in range(1, DEPTHS + 1)}
    rows = elements.withColumns({f"_h{d}": c for d, c in last.items()})
    path = []
    for d in range(1, DEPTHS + 1):
        here = F.col(f"_h{d}")
        upper = [F.coalesce(F.col(f"_h{e}.pos"), F.lit(-1)) for e in range(1, d)]
        alive = here.isNotNull() & (here["pos"] > F.greatest(*upper, F.lit(-1), F.lit(-1)))
        path.append(F.when(alive, here["text"]))
    alive = F.array_compact(F.array(*path))
    return rows.withColumns({
        "section": F.try_element_at(alive, F.lit(-1)), "section_depth": F.size(alive),
        "breadcrumb": F.when(F.size(alive) > 0, F.array_join(alive, " > ")),
    }).drop(*last and [f"_h{d}" for d in last])


def layout_depth(titles: DataFrame, levels: int = 3) -> DataFrame:
    """``depth`` of titles (doc_id, height) by their height within the document's range: 1 for the tallest."""
    whole = Window.partitionBy("doc_id")
    low, high = F.min("height").over(whole), F.max("height").over(whole)
    share = (high - F.col("height")) / (high - low)
    return titles.withColumn("depth", F.when(high == low, 1).otherwise(F.least(F.floor(share * levels).cast("int") + 1, F.lit(levels))))


def page_context(elements: DataFrame) -> DataFrame:
    """(doc_id, page_number, section, breadcrumb) of each page's first element, which tables of the page take."""
    first = F.min_by(F.struct("section", "breadcrumb"), "pos")
    return elements.groupBy("doc_id", "page_number").agg(first.alias("s")).select("doc_id", "page_number", "s.section", "s.breadcrumb")


def fixed_windows(docs: DataFrame, size: int = 512, overlap: int = 64, least: int = 50, tokenize: Callable[[Column], Column] = words, between: str = " ") -> DataFrame:
    """Token windows of ``docs`` (doc_id, text), ``size - overlap`` apart: rows (doc_id, start, n_tokens, text).

    A window is kept when it has ``least`` tokens or reaches the end; windows go on after one has reached the end.
    ``tokenize`` makes the array of a text's tokens (words by default), which ``between`` joins again.
    """
    step = size - overlap
    tokens = docs.select("doc_id", tokenize(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    rows = tokens.select("doc_id", "w", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step))).alias("start"))
    rows = rows.withColumn("n_tokens", F.least(F.lit(size), F.col("n") - F.col("start")))
    kept = rows.where((F.col("n_tokens") >= least) | (F.col("start") + size >= F.col("n")))
    return kept.select("doc_id", "start", "n_tokens", F.array_join(F.slice("w", F.col("start") + 1, F.col("n_tokens")), between).alias("text"))


def sentence_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, text) of each sentence."""
    return docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "text"))


def sentence_windows(docs: DataFrame, width: int = 3) -> DataFrame:
    """Sliding windows of ``width`` sentences, shorter at the end: rows (doc_id, pos, text); no shuffle."""
    s = docs.select("doc_id", sentences(F.col("text")).alias("s"))
    wide = F.transform("s", lambda x, i: F.array_join(F.slice("s", i + 1, width), " "))
    return s.select("doc_id", F.posexplode(wide).alias("pos", "text"))


def adjacent_similarity(rows: DataFrame) -> DataFrame:
    """Cosine of each row's vector with the next one's, by (doc_id, pos); the last row of a document has none."""
    after = F.lead("vector").over(Window.partitionBy("doc_id").orderBy("pos"))
    return rows.withColumn("similarity", F.when(after.isNotNull(), cosine(F.col("vector"), after)))


def segments(rows: DataFrame, quantile: float = 0.25) -> DataFrame:
    """Segments of (doc_id, pos, text, similarity): a break follows each similarity strictly below the quantile."""
    doc = Window.partitionBy("doc_id")
    limit = F.percentile("similarity", F.lit(quantile)).over(doc)
    flagged = rows.withColumn("_break", F.when(F.col("similarity") < limit, 1).otherwise(0))
    before = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    numbered = flagged.withColumn("segment", F.coalesce(F.sum("_break").over(before), F.lit(0)).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    return numbered.groupBy("doc_id", "segment").agg(text.alias("text"), F.min("pos").alias("first_pos"), F.count("*").alias("n_sentences"))


def merge_small(parts: Column, least: int = 50) -> Column:
    """Parts of fewer than ``least`` tokens go to the next one, a small last one to the one before."""
    joined = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit(" "), b))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("carry"))

    def step(state: Column, part: Column) -> Column:
        held = joined(state["carry"], part)
        whole = token_count(held) >= least
        return F.struct(
            F.when(whole, F.concat(state["done"], F.array(held))).otherwise(state["done"]).alias("done"),
            F.when(whole, F.lit("")).otherwise(held).alias("carry"),
        )

    def end(state: Column) -> Column:
        done, carry = state["done"], state["carry"]
        n = F.size(done)
        back = F.concat(F.slice(done, 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.try_element_at(done, F.lit(-1)), F.lit(" "), carry)))
        return F.when(carry == "", done).when(n == 0, F.array(carry)).otherwise(back)

    return F.aggregate(parts, start, step, end)


def merge_back(parts: Column, least: int = 50) -> Column:
    """Parts of fewer than ``least`` tokens are appended to the one before them."""

    def step(done: Column, part: Column) -> Column:
        n = F.size(done)
        merged = F.concat(F.slice(done, 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.try_element_at(done, F.lit(-1)), F.lit(" "), part)))
        return F.when((n > 0) & (token_count(part) < least), merged).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def split_large(text: Column, most: int = 512) -> Column:
    """Sentences packed greedily into parts of at most ``most`` tokens; a longer sentence is a part of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"), F.lit(0).alias("n"))
    # each sentence's tokens are counted once; joined by a blank, they add up
    counted = F.transform(sentences(text), lambda s: F.struct(s.alias("s"), token_count(s).alias("n")))

    def step(state: Column, x: Column) -> Column:
        n = state["n"] + x["n"]
        full = (state["held"] != "") & (n > most)
        wider = F.when(state["held"] == "", x["s"]).otherwise(F.concat(state["held"], F.lit(" "), x["s"]))
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["held"]))).otherwise(state["done"]).alias("done"),
            F.when(full, x["s"]).otherwise(wider).alias("held"), F.when(full, x["n"]).otherwise(n).alias("n"),
        )

    return F.aggregate(counted, start, step, lambda st: F.when(st["held"] == "", st["done"]).otherwise(F.concat(st["done"], F.array(st["held"]))))


def semantic_chunks(segmented: DataFrame, least: int = 50, most: int = 512) -> DataFrame:
    """Chunks of segments (doc_id, segment, text): small ones merged, large ones split, small rests merged back."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("segment", "text"))), lambda x: x["text"])
    docs = segmented.groupBy("doc_id").agg(listed.alias("parts"))
    merged = docs.withColumn("parts", merge_small(F.col("parts"), least))
    split = merged.withColumn("parts", F.flatten(F.transform("parts", lambda p: F.when(token_count(p) > most, split_large(p, most)).otherwise(F.array(p)))))
    return split.select("doc_id", F.posexplode(merge_back(F.col("parts"), least)).alias("pos", "text"))


def tree(sections: DataFrame, width: int = 3, least: int = 50) -> DataFrame:
    """Document, section and paragraph nodes of (doc_id, section_no, text): node_id, parent_id, level, doc_id, pos, text.

    Ids derive from content. A section of at most ``width`` sentences and fewer than ``least`` tokens is one paragraph.
    """
    named = sections.withColumn("section_id", sha("section", F.col("doc_id").cast("string"), F.col("section_no").cast("string"), F.col("text")))
    doc_node = sha("document", F.col("doc_id").cast("string"))
    top = named.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_no", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    top = top.select(doc_node.alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("document").alias("level"), "doc_id", F.lit(0).alias("pos"), "text")
    middle = named.select(F.col("section_id").alias("node_id"), doc_node.alias("parent_id"), F.lit("section").alias("level"), "doc_id", F.col("section_no").alias("pos"), "text")
    small = (token_count(F.col("text")) < least) & (F.size(sentences(F.col("text"))) <= width)  # the sentences of few texts only
    parts = F.when(small, F.array("text")).otherwise(merge_back(split_large(F.col("text"), 4 * least), least))
    leaves = named.select("doc_id", "section_id", F.posexplode(parts).alias("pos", "text"))
    leaves = leaves.select(sha("paragraph", F.col("section_id"), F.col("pos").cast("string")).alias("node_id"), F.col("section_id").alias("parent_id"), F.lit("paragraph").alias("level"), "doc_id", "pos", "text")
    return top.unionByName(middle).unionByName(leaves)


def routed(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements to be chunked, and those (tables, image captions) that pass as they are."""
    whole = F.col("modality").isin("table", "image_caption")
    return elements.where(~whole), elements.where(whole)
