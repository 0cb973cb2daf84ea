"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from foliomill.llm import decontaminate, licenses, maintext, phrases, pieces, pii, quality, secrets, sharding, similar, token_store, urls, whitening

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_pieces": pieces.op2_pieces,
    "op3_token_store": token_store.op3_token_store,
    "op4_similar": similar.op4_similar,
    "op5_urls": urls.op5_urls,
    "op6_sharding": sharding.op6_sharding,
    "op7_secrets": secrets.op7_secrets,
    "op8_pii": pii.op8_pii,
    "op9_quality": quality.op9_quality,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_phrases": phrases.op11_phrases,
    "op12_maintext": maintext.op12_maintext,
    "op13_whitening": whitening.op13_whitening,
}
SQL = {"op5_urls": urls.OP5_SQL, "op10_decontaminate": decontaminate.OP10_SQL}
