"""Queries of this subpackage and the SQL equal to them."""

from __future__ import annotations

from tillcast.llm import (
    bpe,
    decontaminate,
    fingerprint,
    language_model,
    license_scan,
    line_dedup,
    near_dedup,
    quality,
    resampling,
    secret_scan,
    suffix_dedup,
    url_filter,
    whitening,
)

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_fingerprint": fingerprint.op6_fingerprint,
    "op7_quality": quality.op7_quality,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_bpe": bpe.op9_bpe,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_resampling": resampling.op12_resampling,
    "op13_language_model": language_model.op13_language_model,
}
SQL = {
    "op1_license_scan": license_scan.SQL,
    "op2_near_dedup": near_dedup.SQL,
    "op3_url_filter": url_filter.SQL,
    "op4_secret_scan": secret_scan.SQL,
    "op5_decontaminate": decontaminate.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op12_resampling": resampling.SQL,
}
