"""The registered queries of this package and their SQL."""

from __future__ import annotations

from . import bpe, compression_quality, fingerprints, html_text, ngram_join, packing, paragraphs, quality_rules, url_filters, warc

MODULES = [
    compression_quality,
    html_text,
    fingerprints,
    packing,
    bpe,
    ngram_join,
    url_filters,
    warc,
    paragraphs,
    quality_rules,
]


def queries() -> dict:
    return {name: call for m in MODULES for name, call in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
