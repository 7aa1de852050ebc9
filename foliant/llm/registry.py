"""Queries of this subpackage and their DuckDB equivalents, collected from the operator modules."""

from __future__ import annotations

import importlib

MODULES = ("near_copies", "differencing_pack", "random_index", "exact_topk", "column_repeats", "string_kernel", "trie_counts", "site_lines", "prefix_bpe", "mpeg_media", "slack_heaps", "hard_negatives", "best_fit_pack")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"foliant.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= getattr(_module, "ORACLE", {})
