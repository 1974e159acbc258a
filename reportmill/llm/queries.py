"""Registered queries of the subpackage: name → (query, SQL form or None)."""

from __future__ import annotations

from reportmill.llm import hard_negatives, html_text, jaccard_join, line_dedup, mixing, near_vectors, pieces, quality, secrets, span_dedup, top_products, url_rules, whitening

_MODULES = (pieces, span_dedup, jaccard_join, near_vectors, html_text, url_rules, secrets, mixing, quality, line_dedup, hard_negatives, top_products, whitening)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
