"""Registry of named queries (Spark builder + optional DuckDB oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkstone.plans.oracle_views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``sql`` is the DuckDB twin; ``views`` names canonical views it needs.
    """

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql.strip(), *views)
        return fn

    return deco


def load_all() -> None:
    # Importing the modules fills the registry.
    from inkstone.plans import (  # noqa: F401
        q_vectors, q_corpus, q_text, q_chunks, q_scan, q_dates, q_json, q_pages, q_keywords, q_streams)
