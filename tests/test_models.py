import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import evaluation
from quillspark.plans import models


def test_each_model_embeds_its_rows(spark):
    rows = spark.createDataFrame([(1, "ab", "short"), (2, "abc", "long"), (3, None, "long"), (4, "d", "short"), (5, "x", "unknown"), (6, "y", None)], "id long, text string, model string").coalesce(1)

    def of(scale):
        # the number of texts of the call is in the vector: one call for each model
        return lambda texts: np.array([[scale * len(t), len(texts)] for t in texts], dtype=np.float32)

    got = {r["id"]: r["v"] for r in models.embedded_by_model(rows, "text", "v", "model", {"short": of(1), "long": of(10)}).collect()}
    assert got == {1: [2.0, 2.0], 2: [30.0, 1.0], 3: None, 4: [1.0, 2.0], 5: None, 6: None}


def test_pairs_are_judged_by_their_opening(spark):
    same = "the same opening words again and again " * 20
    texts = spark.createDataFrame([(1, same + "cats"), (2, same + " dogs and a very long other tail" * 50), (3, "nothing shared here"), (4, None)], "chunk_id long, text string")
    pairs = spark.createDataFrame([(1, 2, "related"), (1, 3, "unrelated"), (1, 4, "related")], "a long, b long, expected string")
    got = {(r["a"], r["b"]): (r["similarity"], r["passed"]) for r in evaluation.text_pair_checks(pairs, texts).collect()}
    assert got[1, 2] == (1.0, True) and got[1, 3][1] and got[1, 4] == (0.0, False)
    whole = {(r["a"], r["b"]): r["similarity"] for r in evaluation.text_pair_checks(pairs, texts, most=10_000).collect()}
    assert whole[1, 2] < 1.0
    assert evaluation.text_pair_checks(pairs.where(F.lit(False)), texts).count() == 0
