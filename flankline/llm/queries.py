"""The queries opN_<name> of this subpackage and, where SQL can express them, the SQL."""

from __future__ import annotations

from . import covertree, divergence, langid, licenses, mixing, packing, quality, repeats, simhash, spelling, topk, toxicity, warc

QUERIES = {
    "op1_quality_cotraining": quality.op1,
    "op2_warc_normaliser": warc.op2,
    "op3_best_fit_packing": packing.op3,
    "op4_exact_top_k": topk.op4,
    "op5_cover_tree_near_dedup": covertree.op5,
    "op6_simhash_near_dedup": simhash.op6,
    "op7_license_scan": licenses.op7,
    "op8_language_crf": langid.op8,
    "op9_source_mixing": mixing.op9,
    "op10_toxicity": toxicity.op10,
    "op11_source_divergence": divergence.op11,
    "op12_spelling_variants": spelling.op12,
    "op13_suffix_dedup": repeats.op13,
}

ORACLE_SQL = {
    "op2_warc_normaliser": warc.SQL,
    "op4_exact_top_k": topk.SQL,
    "op5_cover_tree_near_dedup": covertree.SQL,
    "op7_license_scan": licenses.SQL,
    "op9_source_mixing": mixing.SQL,
    "op11_source_divergence": divergence.SQL,
    "op12_spelling_variants": spelling.SQL,
}
