"""Corpus operators for training data. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from cellweave.llm import decontaminate, fingerprint, html_wrapper, pii, quality, rule_ledger, run_index, sentencepiece_scan, simhash, token_alignment, token_files, vector_codes, warc


def queries() -> dict[str, Callable]:
    return {
        "op1_run_index": run_index.op1_run_index,
        "op2_simhash": simhash.op2_simhash,
        "op3_sentencepiece": sentencepiece_scan.op3_sentencepiece,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_html": html_wrapper.op5_html,
        "op6_warc": warc.op6_warc,
        "op7_quality": quality.op7_quality,
        "op8_fingerprints": fingerprint.op8_fingerprints,
        "op9_pii": pii.op9_pii,
        "op10_token_files": token_files.op10_token_files,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_rule_ledger": rule_ledger.op12_rule_ledger,
        "op13_token_alignment": token_alignment.op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": decontaminate.oracle_sql(), "op11_vector_codes": vector_codes.oracle_sql(), "op12_rule_ledger": rule_ledger.oracle_sql()}
