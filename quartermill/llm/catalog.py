"""The queries of this subpackage and, where SQL can state them, their DuckDB statements."""

from __future__ import annotations

from . import chat_views, license_scan, line_dedup, mixing, quality_fm, sentencepiece_fst, simhash, token_files, transport_stream, vector_search

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_sentencepiece": sentencepiece_fst.query,
    "op3_token_files": token_files.query,
    "op4_license_scan": license_scan.query,
    "op5_quality_classifier": quality_fm.query,
    "op6_simhash": simhash.query,
    "op7_transport_stream": transport_stream.query,
    "op8_vector_search": vector_search.query,
    "op9_chat_views": chat_views.query,
    "op10_mix_sources": mixing.query,
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op8_vector_search": vector_search.SQL,
    "op9_chat_views": chat_views.SQL,
}
