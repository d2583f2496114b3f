"""The registered queries of the training-data operators and the SQL that some of them equal."""

from __future__ import annotations

from quillspark.llm import ann, bpe, divergence, lid, mips, ngram_join, orc_tokens, packing, pii, sharding, urlrep, vector_codes, winnowing

QUERIES = {
    "op1_pii_surrogates": pii.op1_pii_surrogates,
    "op2_url_reputation": urlrep.op2_url_reputation,
    "op3_language_id": lid.op3_language_id,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_orc_tokens": orc_tokens.op5_orc_tokens,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_kmeans_tree": ann.op7_kmeans_tree,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_norm_buckets": mips.op9_norm_buckets,
    "op10_hilbert_shards": sharding.op10_hilbert_shards,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_winnowing": winnowing.op12_winnowing,
    "op13_source_divergence": divergence.op13_source_divergence,
}
SQL = {
    "op2_url_reputation": urlrep.op2_sql(),
    "op4_ngram_join": ngram_join.op4_sql(),
    "op9_norm_buckets": mips.op9_sql(),
    "op11_vector_codes": vector_codes.op11_sql(),
    "op12_winnowing": winnowing.op12_sql(),
    "op13_source_divergence": divergence.op13_sql(),
}
