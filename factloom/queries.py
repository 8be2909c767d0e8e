"""Registered queries of the core analyses and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.plans import api_queries, effect_queries, graph_queries, port_queries, range_queries, similar_queries

AREAS = (effect_queries, graph_queries, port_queries, similar_queries, range_queries, api_queries)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["effect_closure"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for area in AREAS for k, f in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for area in AREAS for k, s in area.SQL.items()}
