"""Registered queries of this package and their SQL twins."""

from __future__ import annotations

from tessaria.llm import filter_audit, fingerprint_index, lm_scores, minhash, packing, periodic_runs, pieces, quality, secrets, sharding, spans, suffix_array, topk, urls


def queries() -> dict:
    return {
        "op1_suffix_array_dedup": suffix_array.query,
        "op2_secret_scans": secrets.query,
        "op3_exact_top_k": topk.query,
        "op4_lm_scoring": lm_scores.query,
        "op5_minhash_near_dedup": minhash.query,
        "op6_quality_rules": quality.query,
        "op7_best_fit_packing": packing.query,
        "op8_substring_dedup": fingerprint_index.query,
        "op9_url_filters": urls.query,
        "op10_sentencepiece_sampling": pieces.query,
        "op11_filter_audit": filter_audit.query,
        "op12_periodic_runs": periodic_runs.query,
        "op13_sharding": sharding.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_array_dedup": spans.SQL, "op8_substring_dedup": spans.SQL, "op3_exact_top_k": topk.SQL, "op4_lm_scoring": lm_scores.SQL, "op5_minhash_near_dedup": minhash.SQL, "op9_url_filters": urls.SQL, "op11_filter_audit": filter_audit.SQL, "op12_periodic_runs": periodic_runs.SQL}
