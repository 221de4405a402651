"""Query plans over the given tables."""

from __future__ import annotations


def all_queries():
    """Every registered query, by name."""
    from corpusmill.plans import (  # noqa: F401
        answer_queries,
        chunk_queries,
        dialogue_queries,
        relational_queries,
        search_queries,
        source_queries,
        table_queries,
        text_queries,
        turn_queries,
    )
    from corpusmill.plans.registry import REGISTRY

    return REGISTRY
