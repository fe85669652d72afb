"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from vellumine.llm import chat, decontaminate, langid, licenses, media, mixing, ngram_join, secrets, toxicity, urls

QUERIES = {
    "op1_language_id": langid.op1,
    "op2_toxicity": toxicity.op2,
    "op3_ngram_join": ngram_join.op3,
    "op4_decontamination": decontaminate.op4,
    "op5_media_columns": media.op5,
    "op6_chat_format": chat.op6,
    "op7_source_mixing": mixing.op7,
    "op8_secret_scan": secrets.op8,
    "op9_url_filter": urls.op9,
    "op10_license_scan": licenses.op10,
}

ORACLE = {
    "op3_ngram_join": ngram_join.sql(),
    "op6_chat_format": chat.sql(),
    "op7_source_mixing": mixing.sql(),
    "op9_url_filter": urls.sql(),
}
