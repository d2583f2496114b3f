import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import dedup, minhash
from quillspark.queries import read


def families(seed=8):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for size in (40, 6, 6, 5, 1, 1, 1):
        base = [word() for _ in range(60)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(60)] = word()
            texts.append(" ".join(t))
    texts += [texts[0].upper(), texts[0] + "  ", "ab", "AB", "", None, "日本語の文"]
    rng.shuffle(texts)
    return texts


def pairs_of(df):
    return {(r["a"], r["b"]): r["jaccard"] for r in df.collect()}


def greedy(texts):
    """Kept places, by the rule and in order."""
    kept, seen = [], set()
    for i, t in enumerate(texts):
        t = None if t is None else " ".join(t.lower().split())
        g = {t[j : j + 3] for j in range(len(t) - 2)} if t else set()
        if t not in seen and not any(g and o and len(g & o) / len(g | o) >= 0.85 for _, o in kept):
            kept.append((i, g))
        seen.add(t)
    return [i for i, _ in kept]


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    x = rng.choice(1 << 40, 900, replace=False).astype(np.uint64)
    for shared in (300, 700):
        a, b = x[:800], np.concatenate([x[:shared], x[800:]])
        want = shared / (800 + 100)
        got = (minhash.signature(a) == minhash.signature(b)).mean()
        assert abs(got - want) < 4 * (want * (1 - want) / 128) ** 0.5
    assert len(set(map(tuple, (minhash.band_hashes(minhash.signature(x[:n])) for n in range(1, 30))))) > 5
    assert minhash.grams("abca\U0001f600bca").tolist() == sorted({sum(ord(c) << s for c, s in zip(g, (42, 21, 0), strict=True)) for g in ("abc", "bca", "ca\U0001f600", "a\U0001f600b", "\U0001f600bc")})
    assert len(minhash.grams("ab")) == 0


def test_pairs_are_right_and_nearly_all(spark):
    docs = spark.createDataFrame(list(enumerate(families())), "id long, text string")
    exact, got = pairs_of(dedup.near_pairs(docs)), pairs_of(minhash.minhash_pairs(docs))
    assert got.items() <= exact.items() and len(exact) > 500 and len(got) >= 0.95 * len(exact)


def test_large_bands_are_cut(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(families())), "id long, text string")
    signed = minhash.signatures(minhash.distinct_texts(docs))
    whole = sorted(map(tuple, minhash.candidates(signed).collect()))
    monkeypatch.setattr(minhash, "BLOCK", 7)
    assert sorted(map(tuple, minhash.candidates(signed).collect())) == whole and len(set(whole)) == len(whole)


def test_small_bands_share_tasks(spark):
    docs = spark.createDataFrame(list(enumerate(families())), "id long, text string")
    signed = minhash.signatures(minhash.distinct_texts(docs))
    plan = minhash.candidates(signed)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas [group#" in plan and len(signed.first()["sig"]) == 256


def test_recall_on_a_whole_table(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents").select(F.col("doc_id").alias("id"), "text")
    exact, got = pairs_of(dedup.near_pairs(docs)), pairs_of(minhash.minhash_pairs(docs))
    assert got.items() <= exact.items() and len(exact) > 20 and len(got) >= 0.95 * len(exact)


def test_keep_equals_the_greedy_rule(spark):
    texts = families()
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for rounds in (1, 3):
        assert sorted(r["id"] for r in minhash.minhash_keep(docs, rounds=rounds).collect()) == greedy(texts)
    assert minhash.minhash_keep(docs.limit(0)).count() == 0


def test_batches_keep_what_one_would(spark, tmp_path):
    texts = families(9)
    index = minhash.BandIndex(spark, f"file://{tmp_path}/bands")
    cuts = [0, 20, 20, 45, len(texts)]
    kept = []
    for batch, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        docs = spark.createDataFrame(list(enumerate(texts))[a:b], "id long, text string")
        for _ in range(1 + (batch == 2)):  # a batch that is run again replaces what it wrote
            new = sorted(r["id"] for r in index.add(docs, batch).collect())
        kept += new
    assert kept == greedy(texts) == sorted(r["id"] for r in index.texts().collect())
