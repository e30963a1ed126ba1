"""Queries and oracle SQL of all operators outside the llm subpackage."""

from __future__ import annotations

import re

from scorelake.plans import analytics_queries, dataset_queries, evaluation_queries, more_queries, scoring_queries, source_queries, streaming_queries

MODULES = [analytics_queries, scoring_queries, dataset_queries, source_queries, streaming_queries, more_queries, evaluation_queries]


def queries() -> dict:
    """Every function of the query modules whose name is an operator's id and a word."""
    return {name: f for m in MODULES for name, f in vars(m).items() if re.fullmatch(r"[a-z]\d+_\w+", name) and callable(f)}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
