"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from ledgerline.llm import (
    byte_bpe,
    chat_format,
    decontaminate,
    embedding_dedup,
    html_text,
    line_dedup,
    minhash_dedup,
    sharding,
    toxicity,
    url_filter,
)

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_sharding": sharding.op4_sharding,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_minhash_dedup": minhash_dedup.op7_minhash_dedup,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_html_text": html_text.op10_html_text,
}

ORACLE_SQL = {
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op6_embedding_dedup": embedding_dedup.OP6_SQL,
    "op7_minhash_dedup": minhash_dedup.OP7_SQL,
    "op9_chat_format": chat_format.OP9_SQL,
}
