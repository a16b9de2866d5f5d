"""Operators of a training-data pipeline.  Nothing else in the library imports this folder."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Registers a query over the tables of a folder, with its DuckDB form if there is one."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def load() -> None:
    """Imports the modules that register queries."""
    from talkweave.llm import (  # noqa: F401
        html, mixing, negatives, packing, pii, perplexity, quality, secrets, shards, shingles, suffixes, topk, trie,
    )
