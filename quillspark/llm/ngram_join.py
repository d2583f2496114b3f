"""N-gram Jaccard join over prefix trees: near-duplicate classes of whole texts, exact at the threshold.

The sets are kept in one global order, the widely shared shingles last, the others by their hash. Two sets that
meet the threshold share a shingle among the first few of each (the prefix; of the smaller set, among even fewer).

1. Count, in every task over all texts, the shingles that repeat there; those with high totals are ordered last.
   The order changes the cost only, never the result. The same pass takes each text's set size and a 128-bit mark
   of its set; equal sets collapse to one member.
2. Prefix shingles go, packed, to buckets of their range, where those that no other set of like size has are
   dropped and those that the same sets have become one. Hot shingles need no such test and stay where they are.
   Sets of like size must share many prefix shingles, not one: those that share too few with all others are left.
3. Members that share prefix shingles meet in parts of bounded size (each goes where most others go; every part
   of a large group also holds the group's pivot). The sets come from a second pass over the texts, behind a
   bitmap of the members. A part's sets form a trie; each set is matched by a traversal that shares partial
   overlaps and cuts subtrees that can no longer reach the threshold.
4. What is left, pairs on a shared prefix shingle whose components differ, is joined with bounds on sizes and on
   the number of shared shingles, bounded by small histograms of the sets, and verified: first only between
   components' members that share most, then all of it. Texts that only share a passage don't meet, nor do near copies that
   differ in more places than a link allows; and a pair comes from the rarest shingles that it shares, not from all
   of them. Sets are never stored; the few that a step needs come from a pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.bpe import release
from quillspark.llm.common import bounded_batches, components, materialize, shuffle_parts, table
from quillspark.llm.textsets import shingle_sets

#: A shingle is ordered last when its counted total reaches this.
HOT_FROM = 32
#: At most this many shingles are ordered last (the list is broadcast: 16 bytes each).
HOT_MOST = 400_000
#: Shingles counted together in a task before the repeated ones are passed on.
COUNTED = 2_000_000
#: Members of one part of a bucket, its trie held in memory.
PART = 256
#: Rounds of matching between the components' middle members before all pairs that are left.
PIVOT_ROUNDS = 1
#: Shingles for each cell of a set's histogram, at most about, and the fewest cells.
CELL, CELLS = 2, 64
#: Steps of a shingle's place within a set's prefix.
PLACES = 256
#: A pair is left to a rarer shingle where that is among so many next ones of both sets.
RARER = 8
#: Words of 64 bits of a set's bit signature.
WORDS = 16
#: Rows of a side that may be broadcast (some 40 bytes each); a longer one is shuffled.
BROADCAST_ROWS = 200_000
#: Prefix shingles of one bucket, at most about.
BUCKET_ROWS = 600_000
#: Steps of the size scale within the threshold.
SIZE_STEPS = 4
#: The members' bitmap has at most two to this power bits (32 MB).
BITMAP_MOST = 28


def least_overlap(n: int, m: int, percent: int) -> int:
    """The smallest intersection with 100 * i >= percent * (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


class Order:
    """The global order of shingles: rare ones by hash, then the hot ones by count and hash."""

    def __init__(self, hot: np.ndarray, counts: np.ndarray) -> None:
        by = np.argsort(hot)
        self.hot, place = hot[by], np.empty(len(hot), dtype=np.int64)
        place[np.lexsort((hot, counts))] = np.arange(len(hot))
        self.place = place[by]

    def is_hot(self, s: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(s), dtype=bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, s), len(self.hot) - 1)] == s

    def sort(self, s: np.ndarray) -> np.ndarray:
        """``s`` (ascending) in the global order."""
        if not len(self.hot) or not len(s):
            return s
        at = np.minimum(np.searchsorted(self.hot, s), len(self.hot) - 1)
        is_hot = self.hot[at] == s
        hot = s[is_hot]
        return np.concatenate((s[~is_hot], hot[np.argsort(self.place[at[is_hot]])]))


def _marks_of(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128-bit mark of a set."""
    salt = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
    with np.errstate(over="ignore"):
        mixed = [(s ^ k) * (s | np.uint64(1)) for k in salt]
        return tuple(np.sum((m ^ (m >> np.uint64(29))) * salt[0], dtype=np.uint64) for m in mixed)


def _signed(values: list) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def _first_pass(width: int):
    """Rows of the texts' marks (s null), and of the shingles that repeat within the task (n null)."""

    names = ["doc_id", "n", "hi", "lo", "s", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, size = [], 0

        def repeated() -> pa.RecordBatch:
            s = np.concatenate(held)
            held.clear()
            s.sort()
            first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            c = np.diff(np.concatenate((first, [len(s)])))
            s, c = s[first[c > 1]].view(np.int64), c[c > 1]
            none = pa.nulls(len(s), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(s), pa.array(c)], names=names)

        for batch in batches:
            n, hi, lo = [], [], []
            for s in shingle_sets(batch.column("text"), width):
                marks = _marks_of(s)
                n.append(len(s))
                hi.append(marks[0])
                lo.append(marks[1])
                held.append(s)
                size += len(s)
                if size >= COUNTED:
                    yield repeated()
                    size = 0
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(_signed(hi)), pa.array(_signed(lo)), none, none], names=names)
        if size:
            yield repeated()

    return run


def _order(repeated: DataFrame) -> Order:
    """The order from the repeated shingles (s, c) of all tasks; the list is cut by total, never by place."""
    totals = repeated.groupBy("s").agg(F.sum("c").alias("n"))
    totals = materialize(totals.where(F.col("n") >= HOT_FROM), "hot")
    steps = {r["k"]: r["c"] for r in totals.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("c")).collect()}
    lowest, room = max(steps, default=0) + 1, HOT_MOST
    for k in sorted(steps, reverse=True):
        if (room := room - steps[k]) < 0:
            break
        lowest = k
    hot = totals.where(F.floor(F.log2("n")) >= lowest).toPandas()
    return Order(hot["s"].to_numpy(np.int64).view(np.uint64), hot["n"].to_numpy(np.int64))


def _step(n: int, percent: int) -> int:
    """Size of a set on a scale where sizes within the threshold are at most SIZE_STEPS + 1 apart."""
    return int(np.log(n) / -np.log(min(percent, 99.9) / 100) * SIZE_STEPS)


def _prefixes(width: int, percent: int, order, buckets: int):
    """Prefix shingles of the texts, packed by bucket; the hot ones, shared for certain, in further buckets by set.

    Equal sets give theirs once per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, size, seen = [], 0, set()

        def packed() -> pa.RecordBatch:
            s = np.concatenate([h[0] for h in held])
            counts = [len(h[0]) for h in held]
            hi = np.repeat(np.array([h[1] for h in held], dtype=np.uint64), counts)
            step = np.repeat(np.array([h[2] for h in held], dtype=np.int16), counts)
            place = np.concatenate([np.arange(n) * PLACES // n for n in counts]).astype(np.uint8)
            bucket = ((s >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            bucket = np.where(order.value.is_hot(s), buckets + (hi % np.uint64(buckets)).astype(np.int64), bucket)
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[by])) + 1
            parts = np.split(by, cuts)
            columns = [pa.array([v[p].tobytes() for p in parts], pa.binary()) for v in (s, hi, step, place)]
            return pa.RecordBatch.from_arrays([pa.array([int(bucket[p[0]]) for p in parts], pa.int32()), *columns], names=["bucket", "s", "hi", "step", "place"])

        for batch in batches:
            for s in shingle_sets(batch.column("text"), width):
                if (n := len(s)) and (marks := _marks_of(s)) not in seen:
                    seen.add(marks)
                    prefix = order.value.sort(s)[: prefix_length(n, percent)]
                    held.append((prefix, marks[0], _step(n, percent)))
                    size += len(prefix)
                    if size >= COUNTED // 2:
                        yield packed()
                        held, size = [], 0
        if size:
            yield packed()

    return run


def _unpacked(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    join = lambda c, kind: np.frombuffer(b"".join(pdf[c]), dtype=kind)
    return join("s", np.int64), join("hi", np.int64), join("step", np.int16).astype(np.int64), join("place", np.uint8).astype(np.int64)


def _nearer(percent: int) -> int:
    """The last place of a prefix's nearer part; it holds the first shingle that sets of equal size share."""
    return PLACES * 100 // (100 + percent)


def _shared_rows(buckets: int, percent: int):
    """Rows of a bucket whose shingle another set of like size has; shingles that the same sets have get one name.

    ``lead`` is set where one of two sets of like size has it in its nearer part, as sets that link share one there.
    """
    nearer = _nearer(percent)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, hi, step, place = _unpacked(pdf)
        by = np.lexsort((hi, step, s))
        s, hi, step, place = s[by], hi[by], step[by], place[by]
        once = np.concatenate(([True], (s[1:] != s[:-1]) | (hi[1:] != hi[:-1])))
        s, hi, step, place = s[once], hi[once], step[once], place[once]
        if pdf["bucket"].iloc[0] >= buckets:
            return pd.DataFrame({"s": s, "hi": hi, "lead": True})
        group = np.cumsum(np.concatenate(([0], s[1:] != s[:-1]))) * 65536 + step
        low = np.searchsorted(group, group - SIZE_STEPS - 1, side="left")
        high = np.searchsorted(group, group + SIZE_STEPS + 1, side="right")
        near = place <= nearer
        nears = np.concatenate(([0], np.cumsum(near)))
        keep = high - low > 1
        lead = near | (nears[high] - nears[low] > 0)
        s, hi, lead = s[keep], hi[keep], lead[keep]
        return pd.DataFrame({"s": _names(s, hi), "hi": hi, "lead": lead})

    return run


def _names(s: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For rows ordered by shingle, a hash of the sets that have it."""
    if not len(s):
        return s
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    with np.errstate(over="ignore"):
        sets = hi.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sets = (sets ^ (sets >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        names = np.add.reduceat(sets ^ (sets >> np.uint64(29)), first)
    return np.repeat(names, np.diff(np.concatenate((first, [len(s)])))).view(np.int64)


def _least(percent: int, n: str, m: str) -> str:
    return f"(({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent})"


def _prefix(percent: int, n: str) -> str:
    return f"({n} + 1 - (({percent} * {n} + 99) div 100))"


def _in_common(percent: int) -> str:
    """Condition that a shingle must lead to the pair of two sets of n1, n2 shingles that share it, if they may link.

    With a least overlap of t, the first n1 - t + k of the one and n2 - t + k of the other share at least k, for every k. It
    is taken as large as the prefixes hold these; none that two sets of like size share was dropped. In an
    order of all shingles by their number of members, the rarest shared one has the others after it: either set has at
    least k at or after it (``held1``, ``held2``), and none of the rarer ones next to it (``rarer1``, ``rarer2``) is shared.
    """
    room = lambda n: f"({_prefix(percent, n)} - {n} + {_least(percent, 'n1', 'n2')})"
    return f"least(held1, held2) >= greatest(1, least({room('n1')}, {room('n2')})) and not arrays_overlap(rarer1, rarer2)"


def _may_link(percent: int) -> str:
    """Condition that a row of a set of n shingles may be the rarest one shared with any set of ``low`` to ``high``, as in
    ``_in_common``: the bound of its own prefix is least for the smallest such set, that of the other's for the largest
    (but for one, by rounding)."""
    smallest, largest = f"greatest(low, ({percent} * n + 99) div 100)", f"least(high, 100 * n div {percent})"
    own = f"({_prefix(percent, 'n')} - n + {_least(percent, 'n', smallest)})"
    other = f"({_prefix(percent, largest)} - {largest} + {_least(percent, 'n', largest)} - 1)"
    return f"held >= greatest(1, least({own}, {other}))"


#: Bytes of a shingle's hash that travel with a set.
_HASH_BYTES = 6


def _narrow(s: np.ndarray) -> bytes:
    return np.ascontiguousarray(s).view(np.uint8).reshape(-1, 8)[:, :_HASH_BYTES].tobytes()


def _wide(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // _HASH_BYTES, 8), dtype=np.uint8)
    out[:, :_HASH_BYTES] = np.frombuffer(b, dtype=np.uint8).reshape(-1, _HASH_BYTES)
    return out.view(np.int64).reshape(-1)


def _histogram(s: np.ndarray) -> bytes:
    """How many shingles fall to each cell, in as many cells as suit the set's size; nothing if a cell overflows."""
    cells = max(CELLS, 1 << (len(s) // CELL).bit_length())
    counts = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _bits(s: np.ndarray) -> bytes:
    """A bit for each value of ten bits of the shingles' hashes."""
    held = np.zeros(64 * WORDS, dtype=bool)
    held[((s >> np.uint64(20)) & np.uint64(64 * WORDS - 1)).astype(np.int64)] = True
    return np.packbits(held, bitorder="little").tobytes()


def _sketch(s: np.ndarray) -> bytes:
    return _bits(s) + _histogram(s)


def _bit_room(a: bytes, b: bytes, n1: int, n2: int, percent: int) -> bool:
    """Whether the bits of two sketches leave room for the least overlap of sets of n1, n2 shingles: each bit that only one of
    them has stands for a shingle that only it has."""
    x, y = (np.frombuffer(v, dtype=np.uint64, count=WORDS) for v in (a, b))
    apart = lambda v, w: int(np.bitwise_count(v & ~w).sum())
    return (100 + percent) * min(n1 - apart(x, y), n2 - apart(y, x)) >= percent * (n1 + n2)


def _room(a: bytes, b: bytes, percent: int) -> bool:
    """Whether two histograms leave room for the least overlap: the sum of the smaller cells bounds the intersection.

    They follow the bits of the sketches. The finer one is folded to the cells of the other; one that overflowed bounds
    nothing.
    """
    a, b = a[8 * WORDS :], b[8 * WORDS :]
    if not a or not b:
        return True
    x, y = (np.frombuffer(h, dtype=np.uint8).astype(np.int32) for h in (a, b))
    cells = min(len(x), len(y))
    x, y = x.reshape(-1, cells).sum(0), y.reshape(-1, cells).sum(0)
    both = int(np.minimum(x, y).sum())
    return 100 * both >= percent * (int(x.sum()) + int(y.sum()) - both)


def _of_members(width: int, bitmap, make):
    """(hi, lo, value) of texts whose mark is in the bitmap, ``value`` made of the set; equal sets once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = bitmap.value, set()
        mask = np.uint64(len(bits) * 8 - 1)
        for batch in batches:
            rows = []
            for s in shingle_sets(batch.column("text"), width):
                if len(s):
                    hi, lo = _marks_of(s)
                    at = int(hi & mask)
                    if bits[at >> 3] >> (at & 7) & 1 and (hi, lo) not in seen:
                        seen.add((hi, lo))
                        rows.append((hi, lo, make(s)))
            yield pa.RecordBatch.from_arrays([pa.array(_signed([r[0] for r in rows])), pa.array(_signed([r[1] for r in rows])), pa.array([r[2] for r in rows], pa.binary())], names=["hi", "lo", "value"])

    return run


def _bitmap(members: DataFrame) -> bytes:
    """Bitmap over the low bits of the members' marks: 16 bits or more a member, up to BITMAP_MOST; false hits only cost."""
    bits = 1 << min(BITMAP_MOST, max(18, (16 * members.count()).bit_length()))
    place = F.col("hi").bitwiseAND(bits - 1) + 1
    parts = members.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("b"))
    out = bytearray(bits // 8)
    for r in parts.toLocalIterator():
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = r["b"]
    return bytes(out)


class _Node:
    """A run of shingles shared by all sets below, with the bounds of their sizes and one of their members."""

    __slots__ = ("tokens", "children", "low", "high", "ends")

    def __init__(self, tokens: np.ndarray, low: int, high: int) -> None:
        self.tokens, self.children, self.low, self.high, self.ends = tokens, {}, low, high, []


class Trie:
    """Compressed prefix tree of globally ordered sets."""

    def __init__(self) -> None:
        self.root = _Node(np.empty(0, dtype=np.int64), 1 << 60, 0)

    def add(self, s: np.ndarray, member: int) -> None:
        node, at, n = self.root, 0, len(s)
        while True:
            node.low, node.high = min(node.low, n), max(node.high, n)
            if at == n:
                node.ends.append(member)
                return
            child = node.children.get(int(s[at]))
            if child is None:
                leaf = _Node(s[at:], n, n)
                leaf.ends.append(member)
                node.children[int(s[at])] = leaf
                return
            span = min(len(child.tokens), n - at)
            differ = np.flatnonzero(child.tokens[:span] != s[at : at + span])
            same = int(differ[0]) if len(differ) else span
            if same < len(child.tokens):  # split the run
                upper = _Node(child.tokens[:same], child.low, child.high)
                upper.children[int(child.tokens[same])] = child
                child.tokens = child.tokens[same:]
                node.children[int(s[at])] = upper
                child = upper
            node, at = child, at + same

    def matches(self, s: np.ndarray, percent: int, skip) -> Iterator[int]:
        """Members whose sets meet the threshold with ``s``; ``skip(member)`` leaves those out that needn't be known.

        The state of a path is what its runs overlap with ``s`` and how many of ``s`` are passed; it is shared by
        all sets below. A subtree goes when even all that remains on both sides can't reach the least overlap.
        """
        n = len(s)
        ascending = np.argsort(s)
        keys = s[ascending]
        stack = [(c, 0, 0, 0) for c in self.root.children.values()]
        while stack:
            node, depth, overlap, passed = stack.pop()
            least = least_overlap(n, max(node.low, -(-percent * n // 100)), percent)
            if node.high * 100 < percent * n or n * 100 < percent * node.low:
                continue
            if overlap + min(n - passed, node.high - depth) < least:
                continue
            at = np.searchsorted(keys, node.tokens)
            at[at == n] = n - 1
            hit = keys[at] == node.tokens
            found = int(np.count_nonzero(hit))
            if found:
                passed = int(ascending[at[hit][-1]]) + 1
            depth, overlap = depth + len(node.tokens), overlap + found
            if overlap + min(n - passed, node.high - depth) < least:
                continue
            for member in node.ends:
                if not skip(member) and 100 * overlap >= percent * (n + depth - overlap):
                    yield member
            stack.extend((c, depth, overlap, passed) for c in node.children.values())


def trie_join(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each of the sets (in the global order, as int64) the first index of its component among them."""
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    trie = Trie()
    for i in np.argsort([len(s) for s in sets], kind="stable").tolist():
        if len(sets[i]):
            for j in trie.matches(sets[i], percent, lambda j, i=i: find(j) == find(i)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            trie.add(sets[i], i)
    return [find(i) for i in range(len(sets))]


def _join_part(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("rep").sort_values("rep", ignore_index=True)
        sets = [_wide(b) for b in pdf["value"]]
        first = trie_join(sets, percent)
        rep = pdf["rep"].to_numpy()
        out = pd.DataFrame({"a": rep, "b": rep[first]})
        return out[out["a"] != out["b"]]

    return run


def _verified(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                x, y = _wide(x), _wide(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[keep, ["a", "b"]]

    return run


def _possible(percent: int):
    """Pairs whose bits and histograms leave room for the least overlap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = zip(pdf["x"], pdf["y"], pdf["n1"], pdf["n2"], strict=True)
            yield pdf.loc[[_bit_room(x, y, n1, n2, percent) and _room(x, y, percent) for x, y, n1, n2 in pairs], ["a", "b"]]

    return run


def _alike(percent: int) -> str:
    return f"100 * least(n1, n2) >= {percent} * greatest(n1, n2)"


def _alike_rows(rows: DataFrame) -> DataFrame:
    """Rows (s, rep, n, hi, lo, shingles) with the number c of a shingle's members and the ``low`` and ``high`` of their sizes.

    Shingles that the same members have, as those of a shared passage, stand for each other: their rows become one (rows
    of different members that met by chance would only be compared with more).
    """
    mark = lambda *c: F.bit_xor(F.xxhash64(*c))
    shared = rows.groupBy("s").agg(
        F.count("*").alias("c"), F.min("rep").alias("first"), F.max("rep").alias("last"), F.min("n").alias("low"), F.max("n").alias("high"),
        mark("rep", "hi", "lo").alias("x1"), mark("lo", "rep", "hi").alias("x2"),
    ).where("first <> last")
    rows = rows.join(shared.select("s", "c", "low", "high", F.xxhash64("c", "x1", "x2").alias("k")), "s").groupBy(F.col("k").alias("s"), "rep", "n", "hi", "lo")
    return rows.agg(F.sum("shingles").alias("shingles"), F.max("c").alias("c"), F.min("low").alias("low"), F.max("high").alias("high"))


def _able(rows: DataFrame, percent: int) -> DataFrame:
    """The rows (s, rep, n, hi, lo, shingles) of sets that share enough of their prefix with others to link with any.

    ``apart`` is the share of the prefix, in 1/1000, that no other set has: least for the texts in a family's middle.
    """
    of_set = Window.partitionBy("rep", "n", "hi")
    held = F.sum("shingles").over(of_set.orderBy(F.desc("c"), "s").rowsBetween(Window.unboundedPreceding, 0))
    able = rows.withColumn("held", held).withColumn("able", F.max(F.expr(_may_link(percent))).over(of_set))
    prefix = _prefix(percent, "n")
    apart = F.expr(f"1000 * ({prefix} - total) div {prefix}")
    return able.withColumn("total", F.sum("shingles").over(of_set)).where("able").select("s", "rep", "n", "hi", "lo", "shingles", apart.alias("apart"))


def _by_rarity(left: DataFrame) -> DataFrame:
    """Rows (s, rep, n, hi, shingles, label, c) of sets with ``held`` and ``rarer`` as ``_in_common`` takes them; a row stands
    for so many shingles, c sets have it."""
    of_set = Window.partitionBy("rep", "n", "hi").orderBy(F.desc("c"), "s")  # an id may have several sets
    held = F.sum("shingles").over(of_set.rowsBetween(Window.unboundedPreceding, 0))
    rarer = F.collect_list("s").over(of_set.rowsBetween(1, RARER))
    return left.select("s", "rep", "n", "label", held.alias("held"), rarer.alias("rarer"))


def _pairs_left(left: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n1, n2) of sets of different labels that may link, by the shared shingles that must lead to them."""
    one = left.selectExpr("s", "rep a", "n n1", "held held1", "rarer rarer1", "label l1")
    two = left.selectExpr("s", "rep b", "n n2", "held held2", "rarer rarer2", "label l2")
    return one.join(two, "s").where(f"a < b and l1 <> l2 and {_alike(percent)} and {_in_common(percent)}").select("a", "b", "n1", "n2")


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (rep, label) after the links (a, b) between members: components of the labels."""
    if links.isEmpty():
        return labels
    ends = links.join(labels.select(F.col("rep").alias("a"), F.col("label").alias("la")), "a")
    ends = ends.join(labels.select(F.col("rep").alias("b"), F.col("label").alias("lb")), "b")
    found = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    merged = labels.join(found.withColumnRenamed("node", "label"), "label", "left")
    return materialize(merged.select("rep", F.coalesce("component", "label").alias("label")), "labels")


def ngram_classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate classes of ``docs`` (doc_id, text): rows (doc_id, n_shingles, component_id), one per input row.

    Words are runs without ASCII white space, A-Z lower-cased; a text's set holds its distinct ``width``-word
    shingles (all its words as one, where there are fewer). Texts link when 100 * |intersection| >=
    percent * |union|; component_id is the smallest doc_id reachable by links. Null texts and texts without words
    have n_shingles 0 and stand alone. Rows that share a doc_id share its component; a row without one has a null
    component unless its set equals that of another row. Shingles are 64-bit hashes. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    first = docs.mapInArrow(_first_pass(width), "doc_id long, n long, hi long, lo long, s long, c long")
    first = materialize(first, "marks")
    order = spark.sparkContext.broadcast(_order(first.where("c is not null").select("s", "c")))
    marks = first.where("c is null").select("doc_id", "n", "hi", "lo")
    classes = materialize(marks.where("n > 0").groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("rep")), "classes")
    whole = marks.agg(F.sum("n")).first()[0] or 0
    buckets = max(shuffle_parts(spark), whole * (100 - percent) // 100 // BUCKET_ROWS + 1)
    packed = docs.select("text").mapInArrow(_prefixes(width, percent, order, buckets), "bucket int, s binary, hi binary, step binary, place binary")
    met = packed.groupBy("bucket").applyInPandas(_shared_rows(buckets, percent), "s long, hi long, lead boolean")
    met = met.groupBy("s", "hi").agg(F.count("*").alias("shingles"), F.max("lead").alias("lead"))
    # by members; a mark's first half may stand for several classes, which then just meet more
    rows = met.join(classes.where("rep is not null"), "hi").withColumn("lead", F.max("lead").over(Window.partitionBy("hi")))
    rows = materialize(rows.where("lead").select("s", "rep", "n", "hi", "lo", "shingles"), "rows-all")
    rows = materialize(_able(_alike_rows(rows), percent), "able")
    # the shingles that lead to anyone, and the member there that shares most as the group's pivot
    pivot = F.min(F.struct("apart", "rep", "hi", "lo"))
    shared = rows.groupBy("s").agg(F.count("*").alias("c"), pivot.alias("pivot"), F.min("rep").alias("first"), F.max("rep").alias("last"))
    rows = materialize(rows.join(shared.where("first <> last").drop("first", "last"), "s"), "rows")

    best = rows.groupBy("rep", "hi", "lo").agg(F.max(F.struct("c", "s", "pivot")).alias("k")).select("rep", "hi", "lo", "k.*")
    best = best.withColumn("parts", F.ceil(F.col("c") / PART).cast("int"))
    best = materialize(best.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")), "groups")
    members = best.select("rep", "hi", "lo")
    pair = "a long, b long"

    def values(wanted: DataFrame, make) -> DataFrame:
        """``wanted`` (hi, lo, ...) with ``value`` made of each one's set, from a pass over the texts."""
        few = wanted.count() <= BROADCAST_ROWS
        bitmap = spark.sparkContext.broadcast(_bitmap(wanted))
        found = docs.select("text").mapInArrow(_of_members(width, bitmap, make), "hi long, lo long, value binary")
        return found.join(F.broadcast(wanted) if few else wanted, ["hi", "lo"])

    pivots = best.where("parts > 1").groupBy("s", "part", "pivot").agg(F.lit(1).alias("one")).select("pivot.rep", "pivot.hi", "pivot.lo", "s", "part")
    places = materialize(best.select("rep", "hi", "lo", "s", "part").union(pivots), "places")
    placed = values(places, lambda x: _narrow(order.value.sort(x)))
    links = placed.groupBy("s", "part").applyInPandas(_join_part(percent), pair)
    labels = members.select("rep", F.col("rep").alias("label")).distinct()
    labels = _merge(labels, materialize(links.distinct(), "links"))
    histograms = None

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, n1, n2) of members whose sets meet the threshold."""

        def with_both(pairs: DataFrame, held: DataFrame) -> DataFrame:
            side = lambda k, v: held.select(F.col("rep").alias(k), F.col("value").alias(v))
            return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")

        likely = materialize(with_both(pairs, histograms).mapInPandas(_possible(percent), pair).distinct(), "likely")
        if likely.isEmpty():
            return likely
        ends = likely.select(F.col("a").alias("rep")).union(likely.select("b")).distinct()
        held = materialize(values(materialize(members.join(ends, "rep"), "ends"), _narrow), "sets")
        return materialize(with_both(likely, held).mapInPandas(_verified(percent), pair).distinct(), "links")

    def undecided(labels: DataFrame) -> DataFrame:
        """Rows of the shingles whose members are in several components."""
        now = rows.join(labels, "rep")
        open_ = now.groupBy("s").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("c")).where("l0 <> l1")
        return materialize(now.select("s", "rep", "n", "hi", "shingles", "apart", "label").join(open_.select("s", "c"), "s"), "open")

    for _ in range(PIVOT_ROUNDS):
        left = undecided(labels)
        if histograms is None:
            open_members = materialize(members.join(left.select("rep").distinct(), "rep"), "open-members")
            histograms = materialize(values(open_members, _sketch), "histograms")
        firsts = left.groupBy("s", "label").agg(F.min(F.struct("apart", "rep", "n")).alias("m"))
        pivot = firsts.groupBy("s").agg(F.min("m").alias("p"))
        pairs = firsts.join(pivot, "s").where("m.rep <> p.rep").selectExpr("p.rep a", "m.rep b", "p.n n1", "m.n n2").where(_alike(percent))
        links = verified(pairs.distinct())
        if links.isEmpty():
            break
        labels = _merge(labels, links)
    left = undecided(labels)
    pairs = _pairs_left(materialize(_by_rarity(left), "held"), percent).distinct()
    labels = _merge(labels, verified(pairs))

    of_class = classes.join(labels, "rep", "left").select("n", "hi", "lo", F.coalesce("label", "rep").alias("component_id"))
    return marks.join(of_class, ["n", "hi", "lo"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and components of all ``documents``: four words, 85 %. Cases as in ``ngram_classes``."""
    return ngram_classes(table(spark, sf_dir, "documents", "doc_id", "text"), width=4, percent=85)


def op4_sql() -> str:
    """Equal result in SQL; the pairs come from an inverted index over whole sets, as only small tables are compared."""
    return r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM tokens x JOIN tokens y ON x.t = y.t AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON s.doc_id = c.a
"""
