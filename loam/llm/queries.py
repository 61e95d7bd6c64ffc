"""The registered queries of this subpackage and their DuckDB texts."""

from __future__ import annotations

from . import (
    audit,
    bpe,
    fim,
    packing,
    perspectives,
    quality,
    repeats,
    secrets,
    sharding,
    simhash,
    topk,
    toxicity,
    urls,
)

QUERIES = {
    "op1_url_rules": urls.op1_url_rules,
    "op2_secret_cnn": secrets.op2_secret_cnn,
    "op3_columnar_topk": topk.op3_columnar_topk,
    "op4_sparse_suffixes": repeats.op4_sparse_suffixes,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_string_kernel_toxicity": toxicity.op6_string_kernel_toxicity,
    "op7_simhash_gray": simhash.op7_simhash_gray,
    "op8_perspective_rotation": perspectives.op8_perspective_rotation,
    "op9_bpe_trie": bpe.op9_bpe_trie,
    "op10_host_quality": quality.op10_host_quality,
    "op11_label_sharding": sharding.op11_label_sharding,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_filter_audit": audit.op13_filter_audit,
}

ORACLES = {
    "op1_url_rules": urls.ORACLE,
    "op3_columnar_topk": topk.ORACLE,
    "op8_perspective_rotation": perspectives.ORACLE,
    "op10_host_quality": quality.ORACLE,
    "op12_fill_in_middle": fim.ORACLE,
    "op13_filter_audit": audit.ORACLE,
}
