"""The queries of this package and their SQL, for the entry module."""

from __future__ import annotations

from . import attribution, decontamination, language, media, packing, quality, secrets, sharding, simhash, token_files

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_benchmark_decontamination": decontamination.op3_benchmark_decontamination,
    "op4_token_counts": attribution.op4_token_counts,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_flac_media": media.op6_flac_media,
    "op7_token_files": token_files.op7_token_files,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_language_id": language.op9_language_id,
    "op10_ring_sharding": sharding.op10_ring_sharding,
}

#: DuckDB SQL where SQL can express the operator.
ORACLE_SQL: dict[str, str] = {}
