"""Vector codes, decontamination and the source audit against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import divergence, vector_codes, winnowing

EMBEDDINGS = "vec_id long, embedding array<float>, label int, error string, _part int"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- op11


def brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(parts, -(-max((len(q) for _, q, _ in kept), default=0) // parts) * parts)
    kept = [(i, q + [0] * (width - len(q)), label) for i, q, label in kept]
    cut = lambda q, p: q[p * width // parts : (p + 1) * width // parts]
    begin = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(q, p) for _, q, _ in begin] for p in range(parts)]
    near = lambda q, p: min((sum((a - b) ** 2 for a, b in zip(cut(q, p), c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        used = defaultdict(list)
        for _, q, _ in kept:
            for p in range(parts):
                used[p, near(q, p)[1]].append(cut(q, p))
        for (p, e), xs in used.items():
            books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    out = []
    for i, q, label in kept:
        found = [near(q, p) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    by = Counter()
    for *_, error, label in out:
        by[label] += error
    return sorted(((i, c, e, by[label], digest) for i, c, e, label in out), key=repr)


@pytest.mark.parametrize("n, entries", [(60, 16), (9, 256)])
def test_codes_equal_plain_python(spark, n, entries):
    rng = random.Random(n)
    rows = [(i, [rng.choice([-0.3, 0.0, 0.125]) if i % 3 else rng.uniform(-1, 1) for _ in range(8)], rng.choice([0, 1, None])) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    rows += [(3, rows[3][1], 1), (None, rows[4][1], 0), (None, [0.5] * 8, None), (100, None, 1), (101, [nan] + [0.0] * 7, 1), (102, [-inf] * 8, 1), (103, [None] * 8, 1)]
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], EMBEDDINGS)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]  # as floats
    assert rows_of(vector_codes.vector_codes(df, entries=entries)) == brute_codes(rows, entries=entries)


def test_codes_of_odd_tables(spark):
    short = [(1, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (2, [], None), (3, [1.0], 2), (3, [1.0], 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in short], EMBEDDINGS)
    assert rows_of(vector_codes.vector_codes(df)) == brute_codes(short)
    empty = vector_codes.vector_codes(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(Exception, match="components must lie within"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1e9], 1, "", 0)], EMBEDDINGS)).collect()


def test_ball_tree_finds_the_nearest_with_ties():
    rng = np.random.default_rng(5)
    for entries, spread in ((256, 3), (256, 900), (40, 1), (1, 9), (256, (1 << 26) - 1)):  # the last beyond exact floats
        x = rng.integers(-spread, spread + 1, (entries, 6))
        q = np.concatenate([rng.integers(-spread, spread + 1, (500, 6)), x])
        index, far = vector_codes.BallTree(x, leaf=4).nearest(q)
        d = ((q[:, None] - x[None]) ** 2).sum(2)
        assert (index == d.argmin(1)).all() and (far == d.min(1)).all()  # argmin: ties to the lower index


def test_ball_tree_spares_entries_of_clusters():
    rng = np.random.default_rng(6)
    x = (rng.integers(-100_000, 100_000, (16, 8))[:, None] + rng.integers(-50, 51, (16, 16, 8))).reshape(256, 8)
    tree = vector_codes.BallTree(x)
    q = x[rng.integers(0, 256, 2000)] + rng.integers(-9, 10, (2000, 8))
    index, _ = tree.nearest(q)
    assert (index == ((q[:, None] - x[None]) ** 2).sum(2).argmin(1)).all()
    assert tree.tested < len(q) * 256 / 4


# --- op12


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contaminated(docs, items, span=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if (key := tuple(w[at : at + n])) in windows:
                    hit.update(range(at, at + n))
                    found |= windows[key]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_contaminated_equals_plain_python(spark, odd_docs):
    rng = random.Random(2)
    few = lambda n: " ".join(rng.choice(["a", "B", "Ça", "9", "été"]) for _ in range(n))  # noqa: E731  many repeats and ties
    many = lambda n: " ".join(rng.choice(["x", "y", "z"]) + str(rng.randrange(300)) for _ in range(n))
    items = [(i, many(30)) for i in range(20)] + [(20, few(14)), (21, "one two"), (21, "Solo"), (22, None), (23, " ,;- "), (None, many(12)), (24, "a B a"), (25, many(10)), (26, items_copy := many(11)), (26, items_copy)]
    docs = [(100 + i, few(40)) for i in range(20)]
    for i in range(60):
        _, item = items[rng.randrange(len(items))]
        w = (item or "").split()
        a = rng.randrange(len(w) + 1)
        docs.append((200 + i, f"{many(rng.randrange(30))}, {' '.join(w[a : a + rng.randrange(8, 16)]).upper()}. {many(rng.randrange(5))} {item or ''}!"))
    docs += [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + [(None, None), (None, items[0][1]), (7, "x" * 200_000), (8, "ONE-two")]
    df = spark.createDataFrame([(*d, 1, "h") for d in docs], "doc_id long, text string, row int, hash string").repartition(5)
    bench = spark.createDataFrame([(*b, 1) for b in items], "item_id long, text string, size int")
    want = brute_contaminated(docs, items)
    assert rows_of(winnowing.contaminated(df, bench)) == want and sum(r[-1] for r in want) > 50
    # without any item, without any document
    assert all(r["n_hit"] == 0 and not r["contaminated"] for r in winnowing.contaminated(df, bench.limit(0)).collect())
    assert winnowing.contaminated(df.limit(0), bench).count() == 0


def test_winnowing_shares_a_fingerprint_of_every_span():
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghijklmnop") * rng.choice([1, 2])
    for _ in range(200):
        shared = [word() for _ in range(10)]
        sides = [[word() for _ in range(rng.randrange(12))] + shared + [word() for _ in range(rng.randrange(12))] for _ in range(2)]
        places, hashes = zip(*[winnowing.Batch([" ".join(s).encode()]).winnowed(10, 5) for s in sides], strict=True)
        at = [sides[k].index(shared[0]) for k in range(2)]
        assert set(hashes[0].tolist()) & set(hashes[1].tolist()), at
        assert all(b - a <= 6 for p in places for a, b in pairwise(p.tolist()))


def test_filter_holds_all_fingerprints(spark):
    rng = random.Random(3)
    prints = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(3000)] + [0, -1]
    bits = np.frombuffer(winnowing.fingerprint_filter(spark.createDataFrame([(p,) for p in prints], "hash long")), dtype=np.uint8)
    high = np.array(prints, dtype=np.int64).view(np.uint64) >> np.uint64(64 - winnowing.FILTER_BITS)
    flat = np.unpackbits(bits, bitorder="little")
    assert flat[high.astype(np.int64)].all() and flat.sum() == len(set(high.tolist()))


# --- op13


def brute_divergence(docs, min_docs, smoothing=5, ranks=50):
    counts, held, groups = Counter(), Counter(), set()
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts.update((lang, source, t) for t in terms)
        held.update((lang, t) for t in set(terms))
    kept = defaultdict(list)
    for (lang, t), n in held.items():
        if n >= min_docs:
            kept[lang].append(t)
    total = Counter()
    for (lang, _, t), n in counts.items():
        total[lang, t] += n
    share = lambda lang, of: (lambda n: {t: 1 + 10**9 * (of(t) + smoothing) // (n + smoothing * len(kept[lang])) for t in kept[lang]})(sum(of(t) for t in kept[lang]))
    p = {(lang, s): share(lang, lambda t, lang=lang, s=s: counts[lang, s, t]) for lang, s in groups}
    q = {lang: share(lang, lambda t, lang=lang: total[lang, t]) for lang, _ in groups}
    out = []
    for lang, s in groups:
        pairs = [(-sum(abs(p[lang, s][t] - p[lang, o][t]) for t in kept[lang]), o.encode()) for a, o in groups if a == lang and o != s]
        terms = [(-(p[lang, s][t] - q[lang][t]), t.encode()) for t in kept[lang] if counts[lang, s, t] and p[lang, s][t] > q[lang][t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
            out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs", [3, 1000])
def test_divergence_equals_plain_python(spark, min_docs):
    rng = random.Random(8)
    terms = ["the", "The", "été", "ÉTÉ", "日本", "a", "b", "c", "😀x", "it's"]
    docs = [(" ".join(rng.choice(terms) + rng.choice(["", "1", "_"]) for _ in range(rng.randrange(40))), rng.choice(["en", "de", None, ""]), rng.choice(["s", "t", "ü", None])) for _ in range(150)]
    docs += [(None, "en", "silent"), ("", "xx", "only"), ("word", "yy", "p"), ("word " * 3, "yy", "q"), docs[0], docs[0], ("the " * 50_000, "en", "s"), (None, None, None)]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "text string, lang string, source string, count int, term string").repartition(3)
    assert rows_of(divergence.source_divergence(df, min_docs=min_docs)) == brute_divergence(docs, min_docs)


def test_divergence_of_an_empty_table(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.source_divergence(df).count() == 0


def test_shares_count_documents_once(spark):
    docs = spark.createDataFrame([("A a b", "en", "s"), ("a", "en", "t")], "text string, lang string, source string")
    got = divergence.term_counts(docs).groupBy("lang", "term").agg(F.sum("count"), F.sum("docs"))
    assert rows_of(got) == [("en", "a", 3, 2), ("en", "b", 1, 1)]
