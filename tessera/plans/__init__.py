"""All queries over the library's operators."""

from __future__ import annotations

from . import analyses, audits, citations, document_features, extraction, pages_and_files, registry


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLE)
