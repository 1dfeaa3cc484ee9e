"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from marlstone.llm import language_id, lexical_search, media_avi, minhash_dedup, ngram_join, packing, periodic_runs, pii, quality_rules, repeated_bytes, secret_scans, source_mixing, toxicity

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_source_mixing": source_mixing.op2_source_mixing,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_pii": pii.op4_pii,
    "op5_toxicity": toxicity.op5_toxicity,
    "op7_language_id": language_id.op7_language_id,
    "op8_media_avi": media_avi.op8_media_avi,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_repeated_bytes": repeated_bytes.op10_repeated_bytes,
    "op6_secret_scans": secret_scans.op6_secret_scans,
    "op11_minhash_dedup": minhash_dedup.op11_minhash_dedup,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}
SQL = {"op11_minhash_dedup": minhash_dedup.SQL, "op3_quality_rules": quality_rules.SQL, "op9_ngram_join": ngram_join.SQL, "op10_repeated_bytes": repeated_bytes.SQL, "op12_periodic_runs": periodic_runs.SQL, "op13_lexical_search": lexical_search.SQL}
