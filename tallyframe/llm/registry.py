"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quality_model", "language_id", "mixing", "packing", "pii", "media", "quality_rules", "token_files", "warc", "ngram_join", "repeats", "source_audit", "lexical_search")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"tallyframe.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"tallyframe.llm.{m}").SQL.items()}
