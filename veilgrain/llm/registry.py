"""Queries of this package and their SQL."""

from __future__ import annotations

from veilgrain.llm import bpe, decontaminate, exact_dedup, langid, licenses, pii, secrets, simhash, toxicity, warc

QUERIES = {
    "op9_licenses": licenses.op9_licenses,
    "op5_pii": pii.op5_pii,
    "op3_warc": warc.op3_warc,
    "op6_toxicity": toxicity.op6_toxicity,
    "op1_simhash": simhash.op1_simhash,
    "op2_secrets": secrets.op2_secrets,
    "op10_language_id": langid.op10_language_id,
    "op4_bpe": bpe.op4_bpe,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "secret_base_spans": secrets.secret_base_spans,
}

ORACLE_SQL = {
    "op3_warc": warc.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "secret_base_spans": secrets.ORACLE,
}
