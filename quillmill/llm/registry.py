"""The queries of this subpackage and their oracles."""

from __future__ import annotations

from quillmill.llm import ann, bpe, decontaminate, fill_in_middle, importance, langid, near_dedup, pii, secrets, substring_dedup, suffix_dedup, urls, vector_dedup

_QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_pii": pii.op4_pii,
    "op5_urls": urls.op5_urls,
    "op6_ann": ann.op6_ann,
    "op7_secrets": secrets.op7_secrets,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_langid": langid.op10_langid,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_importance": importance.op12_importance,
    "op13_vector_dedup": vector_dedup.op13_vector_dedup,
}
_ORACLES = {
    "op4_pii": pii.SQL,
    "op5_urls": urls.SQL,
    "op7_secrets": secrets.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op11_fill_in_middle": fill_in_middle.SQL,
    "op12_importance": importance.SQL,
}


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return {k: v for k, v in _ORACLES.items() if v}
