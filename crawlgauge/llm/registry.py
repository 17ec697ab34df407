"""The subpackage's queries and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from . import byte_bpe, embedding_dedup, fill_in_middle, language_id, lexical_search, license_scan, line_dedup, ngram_join, oracles, packing, quality_classifier, quality_rules, sharding, suffix_dedup

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_license_scan": license_scan.query,
    "op3_sharding": sharding.query,
    "op4_byte_bpe": byte_bpe.query,
    "op5_embedding_dedup": embedding_dedup.query,
    "op6_quality_classifier": quality_classifier.query,
    "op7_packing": packing.query,
    "op8_ngram_join": ngram_join.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_line_dedup": line_dedup.query,
    "op11_lexical_search": lexical_search.query,
    "op12_language_id": language_id.query,
    "op13_fill_in_middle": fill_in_middle.query,
}
SQL = {
    "op1_quality_rules": quality_rules.SQL,
    "op2_license_scan": license_scan.SQL,
    "op5_embedding_dedup": oracles.EMBEDDINGS,
    "op8_ngram_join": oracles.NGRAMS,
    "op9_suffix_dedup": oracles.BYTES,
    "op10_line_dedup": line_dedup.SQL,
    "op11_lexical_search": lexical_search.SQL,
    "op13_fill_in_middle": fill_in_middle.SQL,
}
