"""Registry of the named queries and their SQL twins."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query over the tables of a folder, with its DuckDB form if there is one."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table as a file stream (the pattern also matches a folder of part files)."""
    schema = table(spark, folder, name).schema
    pattern = f"{folder}/{name}.parque[t]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(pattern)


def load() -> None:
    """Imports the modules that register queries."""
    from talkweave.plans import (  # noqa: F401
        queries_jobs, queries_logs, queries_retrieval, queries_sessions, queries_tables, queries_text,
    )
