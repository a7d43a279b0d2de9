"""One query for each operator, with production parameters over its whole table."""

from __future__ import annotations

from holdfast.llm import jaccard, langid, mixing, neardup, pii, sentencepieces, tokenids, tsmedia, warc, wrappers

QUERIES = {
    "op1_sentencepiece": sentencepieces.query,
    "op2_warc": warc.query,
    "op3_html_extraction": wrappers.query,
    "op4_embedding_neardup": neardup.query,
    "op5_ngram_jaccard": jaccard.query,
    "op6_pii": pii.query,
    "op7_language_id": langid.query,
    "op8_media_columns": tsmedia.query,
    "op9_token_ids": tokenids.query,
    "op10_mixing": mixing.query,
}

#: Operators that SQL expresses; tests/llm holds the others against brute force.
ORACLES = {"op10_mixing": mixing.ORACLE}
