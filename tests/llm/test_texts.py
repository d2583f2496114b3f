import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from quillspark.llm import bpe, lid, ngram_join, orc_tokens, packing
from quillspark.llm.common import components, shared_path
from quillspark.llm.textsets import shingle_sets


def plain_sets(texts, width):
    out = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        w = [x for x in low.split(" ") if x]
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def plain_classes(ids, sets, percent):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return {i: find(i) for i in ids}


def family(rng, n, words=60, edits=4):
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(edits)):
            text[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        yield " ".join(text)


def test_shingle_sets():
    texts = ["A b\tC d e", "a b c d e", None, "", "a b", "A  B", "a b c d a b c d", "é É x y z"]
    got = list(shingle_sets(pa.array(texts, pa.string()), 4))
    assert [len(s) for s in got] == [len(s) for s in plain_sets(texts, 4)]
    assert np.array_equal(got[0], got[1]) and np.array_equal(got[4], got[5]) and not len(got[2])
    assert all(np.array_equal(a, next(iter(shingle_sets(pa.array([t], pa.string()), 4)))) for a, t in zip(got, texts, strict=True))


def test_trie_join_equals_brute_force():
    rng = random.Random(2)
    for percent in (60, 80, 85, 100):
        texts = [t for _ in range(6) for t in family(rng, 8)]
        sets = [s.view(np.int64) for s in shingle_sets(pa.array(texts), 4)]
        expected = plain_classes(range(len(texts)), [set(s.tolist()) for s in sets], percent)
        first = ngram_join.trie_join(sets, percent)
        assert [expected[i] for i in range(len(texts))] == [min(j for j in range(len(texts)) if first[j] == first[i]) for i in range(len(texts))]


def test_ngram_classes_equal_brute_force(spark, monkeypatch):
    # small parts, hot shingles and passages that many texts share, so that every step has work
    monkeypatch.setattr(ngram_join, "PART", 8)
    monkeypatch.setattr(ngram_join, "HOT_FROM", 6)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 10)
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [t for n in (1, 2, 30, 5, 3) for t in family(rng, n)] + [f"{passage} {t}" for _ in range(15) for t in family(rng, 1, 12)] + list(family(rng, 20, 8, 2)) + [passage] * 3
    ids = rng.sample(range(1000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    for width, percent in ((4, 85), (5, 80), (2, 60)):
        sets = plain_sets(texts, width)
        expected = plain_classes(ids, sets, percent)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_classes(docs, width, percent).collect()}
        assert got == {i: (len(s), expected[i]) for i, s in zip(ids, sets, strict=True)}


def test_ngram_classes_of_odd_rows(spark, odd_docs, no_docs):
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_classes(odd_docs, 4, 85).collect()), key=str)
    by = {}
    for i, n, c in got:
        by.setdefault(i, []).append((n, c))
    assert len(got) == 11 and by[1] == [(0, 1)] and by[2] == [(0, 2)] and by[3] == [(0, 3)]
    assert by[4] == by[8] == by[9] == [(1, 4)] and len(by[5]) == 2 and by[6][0][1] == 5
    assert ngram_join.ngram_classes(no_docs).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90}


def test_gradients_and_learning():
    net = lid.Network(["a", "b", "c"], hidden=4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x = np.frombuffer(b"abcxyzhelloabcd", dtype=np.uint8).reshape(5, 3)
    y = np.array([0, 1, 2])
    _, grad = net.gradients(x, y)
    for k, w in net.w.items():
        at = np.unravel_index(np.argmax(np.abs(grad[k])), w.shape)
        held, ends = w[at], []
        for e in (1e-4, -1e-4):
            w[at] = held + e
            ends.append(net.gradients(x, y)[0])
        w[at] = held
        assert abs((ends[0] - ends[1]) / 2e-4 - grad[k][at]) < 1e-5
    net = lid.train([("x", "aba abba baba aab " * 5), ("y", "cdc dccd cddc ccd " * 5)], steps=60, batch=8)
    p = net.text_means(pa.array(["abab", "dcdc", ""]))
    assert p[0].argmax() == 0 and p[1].argmax() == 1 and not p[2].any()


def test_text_means_equal_position_by_position():
    """Against the network run one byte at a time over each window."""
    net = lid.Network(["a", "b", "c"], hidden=4)
    soft = lambda v: v / (1 + np.abs(v))

    def states(window, d):
        h, out = np.zeros(4), []
        for byte in window if d == 0 else window[::-1]:
            g, p = net.w["x"][d][:, byte], net.w["u"][d] @ h
            r, z = np.split((1 + soft(g[:8] + p[:8])) / 2, 2)
            h = h + z * (soft(g[8:] + r * p[8:]) - h)
            out.append(net.w["o"][d] @ h)
        return np.array(out if d == 0 else out[::-1])

    texts = ["short", "é" * 200, "one two " * 100, "", "x" * lid.WINDOW, "tail"]
    got = net.text_means(pa.array(["left out", *texts]).slice(1))
    for text, p in zip(texts, got, strict=True):
        data = text.encode()
        each = [lid._softmax(states(data[a : a + lid.WINDOW], 0) + states(data[a : a + lid.WINDOW], 1) + net.w["b"].T, 1) for a in range(0, len(data), lid.WINDOW)]
        assert np.allclose(p, np.concatenate(each).mean(0) if each else 0, atol=1e-5)


def test_held_out_accuracy(spark, sf_dir):
    got = lid.op3_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    hit = [r["lang_pred"] == r["lang"] for r in got.collect()]
    assert len(hit) > 200 and sum(hit) >= 0.98 * len(hit)


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    net = lid.train([("en", "the cat and the dog"), ("de", "der und die das")], steps=40, batch=4)
    got = lid.predict(odd_docs, net, ["doc_id", "score", "n"])
    assert got.columns == ["doc_id", "score", "n", "lang_pred", "score"]
    rows = [(r[0], r[3]) for r in got.collect()]
    assert len(rows) == 11 and dict(r for r in rows if r[0] in (1, 2, 3, 7)) == {1: "und", 2: "und", 3: "und", 7: "und"}
    assert {r[1] for r in rows if r[0] in (4, 5)} <= {"en", "de"}
    assert lid.predict(no_docs, None, ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in lid.predict(odd_docs, lid.train([]), ["doc_id"]).collect()} == {"und"}


ODD = ["It's DON'T we'LL", "a <|endoftext|> b", "x<|startoftext|>  <|ENDOFTEXT|>y", "tail<|endoftext|>", "naïve café ÀÉ ß ½ ²", "ΑΣΣ Привет İstanbul é", "a b\x1cc d  \n\t x", "<|endoftext|>", "日本語 テスト 123456", "", "   ", "\n", "  lead and trail \n ", "x" * 300, "l'été 's 'S", "tab\tend\r\n"]


def test_piece_encoders_equal_the_libraries():
    words = bpe.WordEncoder(bpe.vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    by_bytes = bpe.ByteEncoder(bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    for encoder, name in ((words, "word_bpe_49k.json"), (by_bytes, "byte_bpe_50k.json")):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        assert [ids.tolist() for ids in encoder(pa.array(ODD))] == [library.encode(t, add_special_tokens=False).ids for t in ODD]
        assert [ids.tolist() for ids in encoder(pa.array([None], pa.string()))] == [[]]


def test_distinct_word_encoding(spark, odd_docs, no_docs, monkeypatch):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = bpe.tiktoken_encoding(bpe.vocabulary(path), public_tokenizers.PATTERN)
    docs = spark.createDataFrame(list(enumerate([*ODD, None])), "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs, path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate([*ODD, None]):
        ids = library.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_decode(odd_docs, path, public_tokenizers.PATTERN).count() == 11
    assert bpe.encode_decode(no_docs, path, public_tokenizers.PATTERN).count() == 0


def test_orc_round_trip(spark, odd_docs, no_docs):
    name = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(name)
    path = shared_path(spark, "orc-test")
    docs = spark.createDataFrame([(50 - i, t) for i, t in enumerate([*ODD, None])], "doc_id long, text string").repartition(3)
    orc_tokens.write_tokens(docs, path, name, 1)
    tokens = orc_tokens.read_tokens(spark, path)
    start = 0
    for r in orc_tokens.token_index(tokens).orderBy("doc_id").collect():
        t = [*ODD, None][50 - r["doc_id"]]
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    plan = tokens.where("doc_id = 45")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,45)]" in plan and tokens.where("doc_id = 45").count() == 1
    for df, n in ((odd_docs, 11), (no_docs, 0)):
        path = shared_path(spark, "orc-test")
        orc_tokens.write_tokens(df, path, name, 1)
        assert orc_tokens.token_index(orc_tokens.read_tokens(spark, path)).count() == n


def test_orc_filters_skip_rows(spark):
    """A lookup by doc_id reads the row groups that can hold it, not the file."""
    path = shared_path(spark, "orc-test")
    docs = spark.range(6 * orc_tokens.INDEX_ROWS).selectExpr("id * 2 AS doc_id", "'word ' || id AS text").coalesce(1)
    orc_tokens.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), 1)

    def read(condition):
        found = orc_tokens.read_tokens(spark, path).where(condition)
        n = len(found.collect())
        return n, found._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()

    assert read("doc_id = 4242")[0] == 1 and read("doc_id = 4242")[1] <= orc_tokens.INDEX_ROWS
    assert read("doc_id = 4243") == (0, 0)  # between two ids: the Bloom filter has it not
    assert read("doc_id >= 0") == (6 * orc_tokens.INDEX_ROWS,) * 2


def best_fit(lengths, capacity):
    import bisect

    bins, n = [], 0
    for length in sorted(lengths, reverse=True):
        k = bisect.bisect_left(bins, length)
        if k == len(bins):
            n += 1
            left = capacity - length
        else:
            left = bins.pop(k) - length
        bisect.insort(bins, left)
    return n


def test_plan_equals_best_fit_decreasing():
    from collections import Counter

    for seed in range(40):
        rng = random.Random(seed)
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(0, 500))]
        used, seen = Counter(), Counter()
        for length, first, last, bin_, per, at in packing.plan(Counter(lengths), 100):
            for k in range(first, last):
                place = bin_ + (k - first) // per
                assert used[place] == at + (k - first) % per * length
                used[place] += length
                seen[length] += 1
        assert seen == Counter(lengths) and max(used.values(), default=0) <= 100 and len(used) == best_fit(lengths, 100)


def test_packing(spark, odd_docs, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(odd_docs, path, capacity=64).toPandas()
    assert got["length"].max() == 64 and (got["length"] + got["offset"]).max() <= 64
    assert got[got["doc_id"] == 1][["start", "length"]].values.tolist() == [[0, 1]]
    for _, x in got.sort_values("offset").groupby("sequence_id"):
        assert x["offset"].tolist() == [0, *x["length"].cumsum().tolist()[:-1]]
    assert got["sequence_id"].nunique() == best_fit(got["length"].tolist(), 64)
    assert packing.pack(no_docs, path).count() == 0
    ids = np.array([*Tokenizer.from_file(path).encode("one two", add_special_tokens=False).ids, 0], dtype="<u4")
    assert got[got["doc_id"] == 4]["ids_crc32"].tolist() == [zlib.crc32(ids.tobytes())]


def test_sketches_never_cut_a_link():
    rng = np.random.default_rng(1)
    cut = 0
    for n in (1, 3, 40, 300, 700, 3000):
        for percent in (80, 85):
            for _ in range(60):
                shared, own = int(n * rng.uniform(0, 1)), rng.integers(0, 8, 2) if n < 40 else rng.integers(0, n // 2, 2)
                whole = rng.integers(0, 1 << 63, shared + int(own.sum()), dtype=np.uint64)
                a, b = np.unique(whole[: shared + own[0]]), np.unique(np.concatenate([whole[:shared], whole[shared + own[0] :]]))
                if not len(a) or not len(b):
                    continue
                both = len(np.intersect1d(a, b))
                bits = [np.unpackbits(np.frombuffer(ngram_join._bits(x), dtype=np.uint8)).astype(bool) for x in (a, b)]
                overlap = min(len(a) - (bits[0] & ~bits[1]).sum(), len(b) - (bits[1] & ~bits[0]).sum())
                assert overlap >= both
                linked = 100 * both >= percent * (len(a) + len(b) - both)
                room = ngram_join._room(ngram_join._sketch(a), ngram_join._sketch(b), percent)
                assert room or not linked
                cut += not room
    assert cut > 100
    full = ngram_join._sketch(np.zeros(300, dtype=np.uint64))  # one cell overflows: nothing is known
    assert full[8 * ngram_join.WORDS :] == b"" and ngram_join._room(full, full, 80)


def test_ngram_classes_of_long_texts_equal_brute_force(spark, monkeypatch):
    # families around the threshold, some members shorter, in parts of two: most links are left to the last join
    monkeypatch.setattr(ngram_join, "PART", 2)
    monkeypatch.setattr(ngram_join, "HOT_FROM", 8)
    rng = random.Random(6)
    texts = []
    for words, edits in ((500, 14), (500, 24), (1500, 45), (90, 4)):
        for t in family(rng, 14, words, edits):
            w = t.split()
            texts.append(" ".join(w[: len(w) - rng.choice((0, 0, 1, len(w) // 20, len(w) // 8))]))
    ids = rng.sample(range(1000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    for width, percent in ((4, 85), (5, 80)):
        sets = plain_sets(texts, width)
        expected = plain_classes(ids, sets, percent)
        assert 8 < len(set(expected.values())) < len(ids) - 8
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_classes(docs, width, percent).collect()}
        assert got == {i: (len(s), expected[i]) for i, s in zip(ids, sets, strict=True)}


def test_pairs_left_come_from_few_shingles(spark):
    def pairs(shared, n=2000, members=12):
        # the members' first shingles are the same, more than one set has the others' rows
        rows = [(s, rep, n, rep, 1, rep, members) for rep in range(members) for s in range(shared)]
        rows += [(10_000 * (rep + 1) + s, rep, n, rep, 1, rep, 2) for rep in range(members) for s in range(200 - shared)]
        left = spark.createDataFrame(rows, "s long, rep long, n long, hi long, shingles long, label long, c long")
        return ngram_join._pairs_left(ngram_join._by_rarity(left), 80)

    assert pairs(30).count() == 0  # 30 shingles of a passage, in the prefixes of 401, are too few for a link
    many = pairs(180)
    assert many.count() == many.distinct().count() == 66  # each pair once, not once for each of 180 shingles


def test_near_copies_below_the_threshold_make_no_pairs(spark):
    # a family's shingles are ordered last; twelve own ones of 147 are more than a link allows two equally long sets
    for shared, expected in ((11, 0), (12, 66)):
        rows = [(s, rep, 147, rep, 1, rep, 12) for rep in range(12) for s in range(shared)]
        left = spark.createDataFrame(rows, "s long, rep long, n long, hi long, shingles long, label long, c long")
        assert ngram_join._pairs_left(ngram_join._by_rarity(left), 85).count() == expected


def test_family_of_near_copies_equals_brute_force(spark, monkeypatch):
    # one text with up to five words replaced: the members with few edits are one class, most others link with nothing
    monkeypatch.setattr(ngram_join, "PART", 16)
    monkeypatch.setattr(ngram_join, "HOT_FROM", 8)
    made, plain = [], ngram_join._pairs_left
    monkeypatch.setattr(ngram_join, "_pairs_left", lambda left, percent: made.append((p := plain(left, percent)).count()) or p)
    rng = random.Random(9)
    base, texts = [f"b{i}" for i in range(150)], []
    for k in range(240):
        w = base[: 150 - rng.choice((0, 0, 0, 3))]
        for at in rng.sample(range(len(w)), rng.randint(1, 5)):
            w[at] = f"e{k}x{at}" if rng.random() < 0.8 else f"e{at}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = plain_sets(texts, 4)
    expected = plain_classes(range(len(texts)), sets, 85)
    assert 60 < len(set(expected.values())) < 180
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_classes(docs, 4, 85).collect()}
    assert got == {i: (len(s), expected[i]) for i, s in enumerate(sets)}
    assert made[0] < 28_680 // 8  # an eighth of all pairs


def test_sets_that_share_too_few_shingles_are_left(spark):
    # as in the least case of any two sizes, over every size of the other set
    for percent in (60, 80, 85):
        rows = [(n, n, rng_low, rng_high) for n in (5, 40, 147, 700) for rng_low, rng_high in ((1, 9_000), (n, n), (n - 3, n + 5))]
        sizes = spark.createDataFrame(rows, "rep long, n long, low long, high long")
        bound = ngram_join._may_link(percent).removeprefix("held >= ")
        for r in sizes.selectExpr("*", f"{bound} k").collect():
            prefix = lambda n: ngram_join.prefix_length(n, percent)  # noqa: B023, E731
            room = lambda n, m: min(prefix(n) - n, prefix(m) - m) + ngram_join.least_overlap(n, m, percent)  # noqa: B023, E731
            others = [m for m in range(max(1, r["low"]), r["high"] + 1) if 100 * min(m, r["n"]) >= percent * max(m, r["n"])]
            least = min(max(1, room(r["n"], m)) for m in others)
            assert least - 2 <= r["k"] <= least
    # two sets with ten shared shingles and two with forty, of 147; a text of any size may link on one
    rows = [(s, rep, 147, rep, rep, 1, 2, 147, 147) for reps, shared in (((1, 2), 10), ((3, 4), 40)) for rep in reps for s in range(1000 * reps[0], 1000 * reps[0] + shared)]
    rows += [(9, 5, 147, 5, 5, 1, 2, 20, 900)]
    found = ngram_join._able(spark.createDataFrame(rows, "s long, rep long, n long, hi long, lo long, shingles long, c long, low long, high long"), 85)
    assert {r["rep"] for r in found.select("rep").distinct().collect()} == {3, 4, 5}


def test_shingles_of_the_same_sets_get_one_name():
    packed = [np.array(v, dtype=t).tobytes() for v, t in (([1, 1, 2, 2, 3, 3, 3, 4], np.int64), ([7, 8, 7, 8, 7, 8, 9, 7], np.int64), ([4] * 8, np.int16), ([0, 255, 255, 255, 9, 9, 9, 0], np.uint8))]
    pdf = pd.DataFrame({"bucket": [0], **dict(zip(("s", "hi", "step", "place"), ([p] for p in packed), strict=True))})
    got = ngram_join._shared_rows(4, 85)(pdf)
    names = got.groupby("s")["hi"].agg(list).tolist()
    assert sorted(map(sorted, names)) == [[7, 7, 8, 8], [7, 8, 9]]
    assert got["lead"].tolist() == [True, True, False, False, True, True, True]
    hot = ngram_join._shared_rows(0, 85)(pd.concat([pdf, pdf]))
    assert hot[["s", "hi"]].values.tolist() == [[1, 7], [1, 8], [2, 7], [2, 8], [3, 7], [3, 8], [3, 9], [4, 7]] and hot["lead"].all()
