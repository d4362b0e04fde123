"""All queries of the corpus operators, with their SQL where there is one."""

from __future__ import annotations

from importlib import import_module

MODULES = ["line_dedup", "sharding", "language_id", "url_filter", "simhash_dedup", "weak_quality", "bpe_automaton", "quality_rules", "decontamination", "html_extract", "phrase_mining", "minhash_dedup", "conversation_repair"]


def _all(name: str) -> dict:
    got: dict = {}
    for m in MODULES:
        got |= getattr(import_module(f"{__package__}.{m}"), name)
    return got


def queries() -> dict:
    return _all("QUERIES")


def sql() -> dict:
    return _all("SQL")
