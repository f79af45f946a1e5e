"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from ragspark.llm import decontaminate, langid, licenses, lines, neighbours, packing, phrases, quality, resampling, secrets, sharding, simhash, substrings

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_nearest_neighbours": neighbours.op2_nearest_neighbours,
    "op3_simhash": simhash.op3_simhash,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_secret_scans": secrets.op5_secret_scans,
    "op6_language_id": langid.op6_language_id,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_license_scans": licenses.op8_license_scans,
    "op9_packing": packing.op9_packing,
    "op10_substring_dedup": substrings.op10_substring_dedup,
    "op11_quality_rules": quality.op11_quality_rules,
    "op12_phrase_mining": phrases.op12_phrase_mining,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}

ORACLES = {
    "op1_sharding": sharding.OP1_SQL,
    "op8_license_scans": licenses.OP8_SQL,
    "op11_quality_rules": quality.OP11_SQL,
    "op12_phrase_mining": phrases.OP12_SQL,
    "op13_importance_resampling": resampling.OP13_SQL,
}
