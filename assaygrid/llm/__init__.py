"""Operators of a training-data pipeline over a ``documents`` table, and the queries that apply them.

Operators take DataFrames and name the columns they read; rows are never identified by ``doc_id`` alone,
which may be null or repeated. Every module keeps its operator, its ``opN_`` query and, where SQL can
express it, the query's SQL.
"""

from importlib import import_module

MODULES = ["mixing", "secrets", "rules", "language", "toxicity", "ranking_quality", "bpe", "repeats", "minhash", "search", "alignment", "token_files", "spelling"]


def catalogs():
    return [import_module(f"assaygrid.llm.{m}").catalog for m in MODULES]
