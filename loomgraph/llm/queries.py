"""The pipeline operators' queries, with SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, fingerprints, language_id, main_text, near_dedup, pii, piece_encoding, suffix_dedup, token_files, url_filter

QUERIES = {
    "op1_language_id": language_id.op1,
    "op2_suffix_dedup": suffix_dedup.op2,
    "op3_token_files": token_files.op3,
    "op4_url_filter": url_filter.op4,
    "op5_fingerprints": fingerprints.op5,
    "op6_pii": pii.op6,
    "op7_main_text": main_text.op7,
    "op8_piece_encoding": piece_encoding.op8,
    "op9_decontamination": decontaminate.op9,
    "op10_near_dedup": near_dedup.op10,
}
ORACLE_SQL: dict[str, str] = {
    "op9_decontamination": decontaminate.SQL,
}
