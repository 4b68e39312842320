"""The queries of this subpackage and the SQL that some of them can be checked against."""

from __future__ import annotations

from . import byte_bpe, chat, line_dedup, merkle, mixing, ngram_join, phrases, quality, ranked, sharding, topk, toxicity, url_filter

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_url_filters": url_filter.op3_url_filters,
    "op4_sharding": sharding.op4_sharding,
    "op5_exact_topk": topk.op5_exact_topk,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
    "op11_ranked_search": ranked.op11_ranked_search,
    "op12_merkle": merkle.op12_merkle,
    "op13_substring_dedup": phrases.op13_substring_dedup,
}

ORACLE_SQL = {
    "op1_ngram_join": ngram_join.ORACLE_SQL,
    "op3_url_filters": url_filter.ORACLE_SQL,
    "op4_sharding": sharding.ORACLE_SQL,
    "op5_exact_topk": topk.ORACLE_SQL,
    "op11_ranked_search": ranked.ORACLE_SQL,
    "op12_merkle": merkle.ORACLE_SQL,
    "op13_substring_dedup": phrases.ORACLE_SQL,
}
