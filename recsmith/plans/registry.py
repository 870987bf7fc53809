"""Named queries: a Spark plan over the given tables plus, where SQL can say
the same thing, the DuckDB oracle text.  ``__spark_entry__`` only wires these."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    # importing the modules registers their queries
    from . import (example_queries, family_queries, metric_queries, ranking_queries, reward_queries, sequence_queries, sid_queries,  # noqa: F401
                   quantize_queries, text_queries, trie_queries, vector_queries)
