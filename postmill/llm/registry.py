"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from postmill.llm import chat, exact_dedup, fim, lexicon, license_scan, lm_score, media, ngram_join, packing, quality, secret_scan, sharding, trie

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_chat_format": chat.op2_chat_format,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_ngram_jaccard_join": ngram_join.op6_ngram_jaccard_join,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op7_media_columns": media.op7_media_columns,
    "op9_bpe_lexicon": lexicon.op9_bpe_lexicon,
    "op10_packing": packing.op10_packing,
    "op11_sharding": sharding.op11_sharding,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_prefix_trie": trie.op13_prefix_trie,
}

ORACLES = {
    "op2_chat_format": chat.OP2_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op12_fill_in_middle": fim.OP12_SQL,
    "op13_prefix_trie": trie.OP13_SQL,
}
