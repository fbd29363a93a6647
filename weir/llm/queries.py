"""The operators' queries, one ``opN_<name>`` each, and SQL where SQL can say the same."""

from __future__ import annotations

from . import audit, bpe, fingerprints, graph, hamming, line_dedup, near_dups, overlaps, packing, quality, repeats, secrets, toxicity

QUERIES = {
    "op1_near_duplicates": near_dups.op1_near_duplicates,
    "op2_bpe": bpe.op2_bpe,
    "op3_quality": quality.op3_quality,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_top_k": hamming.op5_top_k,
    "op6_repeats": repeats.op6_repeats,
    "op7_secrets": secrets.op7_secrets,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_packing": packing.op10_packing,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_overlaps": overlaps.op12_overlaps,
    "op13_nearest_vectors": graph.op13_nearest_vectors,
}
ORACLE_SQL: dict[str, str] = {"op5_top_k": hamming.OP5_SQL, "op9_line_dedup": line_dedup.OP9_SQL, "op11_filter_audit": audit.OP11_SQL, "op12_overlaps": overlaps.OP12_SQL}
