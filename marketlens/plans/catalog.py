"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketlens.plans import flow_queries, learn_queries, market_queries, text_queries

MODULES = (market_queries, text_queries, learn_queries, flow_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: fn for module in MODULES for key, fn in module.QUERIES.items()}


def twins() -> dict[str, str]:
    return {key: text for module in MODULES for key, text in module.SQL.items()}
