"""All queries over the reference relations: name -> callable, name -> DuckDB SQL."""

from __future__ import annotations

from terrane.plans import check_queries, extract_queries, model_queries, text_queries, tree_queries, window_queries

MODULES = (text_queries, tree_queries, check_queries, window_queries, model_queries, extract_queries)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
