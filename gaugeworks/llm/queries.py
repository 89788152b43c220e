"""Registered queries of this package and their SQL where SQL can express them."""

from __future__ import annotations

from . import article, maxscore, mixing, packing, passages, personal, quality, repair, secret_tags, separators, simhash, token_files, trie

QUERIES = {
    "op1_range_coded_ids": token_files.op1_range_coded_ids,
    "op2_pack_documents": packing.op2_pack_documents,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_shared_passages": passages.op4_shared_passages,
    "op5_pivot_simhash": simhash.op5_pivot_simhash,
    "op6_personal_data": personal.op6_personal_data,
    "op7_maxscore": maxscore.op7_maxscore,
    "op8_adaptive_quality": quality.op8_adaptive_quality,
    "op9_separator_scan": separators.op9_separator_scan,
    "op10_extract_articles": article.op10_extract_articles,
    "op11_secret_spans": secret_tags.op11_secret_spans,
    "op12_repair_conversations": repair.op12_repair_conversations,
    "op13_conversation_trie": trie.op13_conversation_trie,
}
SQL = {
    "op3_mix_sources": mixing.SQL,
    "op7_maxscore": maxscore.SQL,
    "op8_adaptive_quality": quality.SQL,
}
