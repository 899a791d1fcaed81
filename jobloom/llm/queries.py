"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import (
    decontamination,
    jaccard_join,
    piece_codec,
    prefix_trie,
    quality_rules,
    secret_scans,
    sharding,
    spelling_variants,
    substring_dedup,
    suffix_tree_lm,
    token_counts,
    tool_links,
    url_filter,
)
from .common import ship


def _shipped(query):
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    found = {
        "op1_sharding": sharding.query,
        "op2_tool_links": tool_links.query,
        "op3_piece_codec": piece_codec.query,
        "op10_jaccard_join": jaccard_join.query,
        "op4_substring_dedup": substring_dedup.query,
        "op5_suffix_tree_lm": suffix_tree_lm.query,
        "op6_decontamination": decontamination.query,
        "op7_token_counts": token_counts.query,
        "op8_quality_rules": quality_rules.query,
        "quality_ablations": quality_rules.ablation_query,
        "op9_secret_scans": secret_scans.query,
        "op11_spelling_variants": spelling_variants.query,
        "op12_url_filter": url_filter.query,
        "op13_prefix_trie": prefix_trie.query,
    }
    return {name: _shipped(q) for name, q in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": sharding.SQL.format(docs="documents"),
        "op4_substring_dedup": substring_dedup.SQL.format(docs="documents"),
        "op6_decontamination": decontamination.SQL.format(docs="documents"),
        "op8_quality_rules": quality_rules.SQL.format(docs="documents"),
        "quality_ablations": quality_rules.ablation_sql("documents"),
        "op9_secret_scans": secret_scans.sql("documents"),
        "op11_spelling_variants": spelling_variants.SQL.format(docs="documents"),
        "op13_prefix_trie": prefix_trie.SQL.format(conversations="conversations"),
    }
