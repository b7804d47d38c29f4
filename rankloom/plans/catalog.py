"""The named queries of the engine and their oracle SQL."""

from __future__ import annotations

from . import evaluation, retrieval, texts


def queries() -> dict:
    return texts.QUERIES | retrieval.QUERIES | evaluation.QUERIES


def oracle_sql() -> dict[str, str]:
    return texts.SQL | retrieval.SQL | evaluation.SQL
