"""The queries of this subpackage, and their SQL twins where SQL can express them."""

from __future__ import annotations

from importlib import import_module

#: query -> module
MODULES = {
    "op1_language_id": "language_crf",
    "op2_url_filter": "url_filter",
    "op3_exact_topk": "exact_topk",
    "op4_chroma": "chroma",
    "op5_ngram_join": "ngram_join",
    "op6_pii": "pii",
    "op7_prefix_free": "prefix_free",
    "op8_line_dedup": "line_dedup",
    "op9_mix_sources": "mixing",
    "op10_byte_bpe": "byte_bpe",
}


def queries() -> dict:
    return {name: getattr(import_module(f"lattica.llm.{m}"), name) for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"lattica.llm.{m}"), "sql", None) for name, m in MODULES.items()}
    return {name: f() for name, f in found.items() if f}
