"""The queries of this folder by name, and the SQL of those that SQL can express."""

from . import fill_middle, language_id, licenses, line_crf, matroska, mixing, near_dedup, packing, piece_counts, quality_rules, secrets_scan, target_resampling, url_filters

QUERIES = {
    "op1_license_scans": licenses.op1_license_scans,
    "op2_packing": packing.op2_packing,
    "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
    "op3_secret_scans": secrets_scan.op3_secret_scans,
    "op4_token_counts": piece_counts.op4_token_counts,
    "op5_media_columns": matroska.op5_media_columns,
    "op6_language_id": language_id.op6_language_id,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_mixing": mixing.op8_mixing,
    "op9_quality_classifier": line_crf.op9_quality_classifier,
    "op11_fill_in_middle": fill_middle.op11_fill_in_middle,
    "op12_url_filters": url_filters.op12_url_filters,
    "op13_target_resampling": target_resampling.op13_target_resampling,
}
ORACLES: dict[str, str] = {
    "op1_license_scans": licenses.OP1_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op11_fill_in_middle": fill_middle.OP11_SQL,
}
