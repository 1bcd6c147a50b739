"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

from .. import ship

#: name of the query: module that has query(spark, sf_dir), and ORACLE where SQL can express it
MODULES = {
    "op1_quality_rules": "quality",
    "op2_projection_forest": "vector_dedup",
    "op3_language_mixture": "language",
    "op4_prefix_intervals": "suffix_dedup",
    "op5_simhash_pigeonhole": "simhash",
    "op6_bpe_transducer": "bpe",
    "op7_multi_index_hashing": "hash_search",
    "op8_token_output": "token_output",
    "op9_genetic_packing": "packing",
    "op10_word_paths": "word_paths",
    "op11_digest_counts": "token_counts",
    "op12_prefix_trie": "prefix_trie",
    "op13_parity_bands": "spelling",
}


def _shipped(query):
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _shipped(import_module(f"{__package__}.{module}").query) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
